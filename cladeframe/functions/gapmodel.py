"""Two-state gap model and log-odds arithmetic as column expressions.

State 0 is "residue", state 1 is "gap"; ``f`` is the overall gap frequency.  The
rate matrix has rank one, so its exponential has the closed form used here.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_ODDS_FLOOR = -100.0


def gap_transition(f: Column, t: Column) -> Column:
    """Struct of the four transition probabilities over a branch of length ``t``."""
    stay = F.exp(-t)
    return F.struct(
        (1 - f + f * stay).alias("p00"),
        (f * (1 - stay)).alias("p01"),
        ((1 - f) * (1 - stay)).alias("p10"),
        (f + (1 - f) * stay).alias("p11"),
    )


def gap_transition_array(f: float, t: np.ndarray) -> np.ndarray:
    """The same closed form for a vector of branch lengths: shape (len(t), 2, 2)."""
    stay = np.exp(-np.asarray(t, dtype=float))
    out = np.empty((stay.size, 2, 2))
    out[:, 0, 0] = 1 - f + f * stay
    out[:, 0, 1] = f * (1 - stay)
    out[:, 1, 0] = (1 - f) * (1 - stay)
    out[:, 1, 1] = f + (1 - f) * stay
    return out


def odds(p: Column, background: Column) -> Column:
    return p / background


def log_odds(p: Column, background: Column) -> Column:
    """``ln(p/background)``, never below the floor (``p = 0`` gives the floor)."""
    ratio = p / background
    return F.when(ratio > 0, F.greatest(F.lit(LOG_ODDS_FLOOR), F.ln(ratio))).otherwise(
        F.lit(LOG_ODDS_FLOOR)
    )


def paired_log_odds(p: Column, q: Column) -> Column:
    """Struct of the log-odds of ``p`` against ``q`` and of their complements."""
    return F.struct(
        log_odds(p, q).alias("gap"), log_odds(1 - p, 1 - q).alias("residue")
    )


def gap_posterior(residue_lik: Column, gap_lik: Column, f: Column) -> Column:
    """Probability that the column holds a residue, given both likelihoods."""
    num = residue_lik * (1 - f)
    return num / (num + gap_lik * f)


def gap_ancestral_prob(residue_lik: Column, gap_lik: Column, f: Column) -> Column:
    """Probability that the column holds a gap, given both likelihoods."""
    num = gap_lik * f
    return num / (residue_lik * (1 - f) + num)
