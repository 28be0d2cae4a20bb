"""Residue alphabets and the scalar expressions over names, residues and states.

Every function takes and returns Spark Columns, so the work stays in generated
code.  Sequences are kept as strings (one byte per residue) rather than integer
arrays: a shuffle or a parquet page then carries four times less.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabets and their state codes.
DNA_SYMBOLS = "_ACMGRSVTWYHKDB-"
DNA4_SYMBOLS = "ACGT-"
AA_SYMBOLS = "ARNDCQEGHILKMFPSTWYVBZ-"
AA_STATES = [
    1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384,
    32768, 65536, 131072, 262144, 524288, 12, 96, 1048575,
]
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Alphabet:
    """A fixed residue alphabet: symbol ``k`` has canonical index ``k``."""

    name: str
    symbols: str
    states: tuple[int, ...]
    fold: tuple[str, str]

    @property
    def gap_state(self) -> int:
        return self.states[-1]

    @property
    def gap_index(self) -> int:
        return len(self.symbols) - 1

    def single(self) -> list[bool]:
        """Which symbols count as one residue: DNA keeps ambiguity codes, AA does not."""
        if self.name == "aa":
            return [bin(s).count("1") == 1 for s in self.states]
        return [s not in (0, self.gap_state) for s in self.states]

    def residues(self) -> str:
        return "".join(c for c, ok in zip(self.symbols, self.single()) if ok)

    def byte_index(self) -> np.ndarray:
        """256-entry byte -> canonical index table (unknown bytes -> gap)."""
        table = np.full(256, self.gap_index, dtype=np.int64)
        for k, c in enumerate(self.symbols):
            table[ord(c)] = k
        return table

    def state_table(self) -> np.ndarray:
        return np.array(self.states, dtype=np.int64)


DNA = Alphabet("dna", DNA_SYMBOLS, tuple(range(16)), (LOWER + "UuNn?.", UPPER + "TT----"))
DNA4 = Alphabet("dna4", DNA4_SYMBOLS, (1, 2, 4, 8, 15), (LOWER + "Uu", UPPER + "TT"))
AA = Alphabet("aa", AA_SYMBOLS, tuple(AA_STATES), (LOWER, UPPER))
ALPHABETS = {a.name: a for a in (DNA, DNA4, AA)}


def alphabet(name_or_alphabet: str | Alphabet) -> Alphabet:
    if isinstance(name_or_alphabet, Alphabet):
        return name_or_alphabet
    return ALPHABETS[name_or_alphabet]


def _char_class(chars: str) -> str:
    return "".join("\\" + c if c in "-^]\\" else c for c in chars)


def normalize_name(name: Column) -> Column:
    """Whitespace runs become ``_``; a run that begins with CR disappears."""
    return F.regexp_replace(F.regexp_replace(name, r"(?<!\s)\r\s*", ""), r"\s+", "_")


def normalize_seq(seq: Column, alpha: str | Alphabet = DNA) -> Column:
    """ASCII upper-casing plus the alphabet's synonyms (DNA: U->T, N ? . -> gap)."""
    src, dst = _fold(alphabet(alpha))
    return F.translate(seq, src, dst)


def _fold(alpha: Alphabet) -> tuple[str, str]:
    # later pairs win over the plain case fold, so build one mapping
    pairs = dict(zip(*alpha.fold))
    if alpha.name == "dna":
        pairs.update({"U": "T", "N": "-"})
    elif alpha.name == "dna4":
        pairs.update({"U": "T"})
    src = "".join(pairs)
    return src, "".join(pairs[c] for c in src)


def keep_known(seq: Column, alpha: str | Alphabet = DNA) -> Column:
    """Delete every character outside the alphabet."""
    return F.regexp_replace(seq, f"[^{_char_class(alphabet(alpha).symbols)}]", "")


def dropped_chars(seq: Column, alpha: str | Alphabet = DNA) -> Column:
    """The complement of :func:`keep_known`: the characters it deletes."""
    return F.regexp_replace(seq, f"[{_char_class(alphabet(alpha).symbols)}]", "")


def query_residues(seq: Column, alpha: str | Alphabet = DNA, strict: bool = False) -> Column:
    """Raw query text -> its single residues, in order.

    ``strict`` tests membership before normalising, so lower case, U and N
    are deleted instead of folded.
    """
    a = alphabet(alpha)
    text = seq if strict else normalize_seq(seq, a)
    return F.regexp_replace(text, f"[^{_char_class(a.residues())}]", "")


def degap(seq: Column, also_unknown: bool = True) -> Column:
    """Remove gaps, and ``N``/``n`` as well unless told otherwise."""
    return F.regexp_replace(seq, "[-Nn]" if also_unknown else "-", "")


def gap_mask(seq: Column) -> Column:
    """``1`` where the residue is a gap or N, ``0`` elsewhere."""
    return F.regexp_replace(F.regexp_replace(seq, "[^-Nn]", "0"), "[-Nn]", "1")


def chars(seq: Column) -> Column:
    return F.split(seq, "")


def encode_cstate(seq: Column, alpha: str | Alphabet = DNA) -> Column:
    """Canonical index of each residue (-1 for a symbol outside the alphabet)."""
    symbols = F.lit(alphabet(alpha).symbols)
    return F.transform(chars(seq), lambda c: F.instr(symbols, c) - 1)


def cstate_to_pstate(cstates: Column, alpha: str | Alphabet = DNA) -> Column:
    a = alphabet(alpha)
    if a.name == "dna":
        return cstates
    states = F.array(*[F.lit(s) for s in a.states])
    return F.transform(cstates, lambda k: F.get(states, k))


def encode_pstate(seq: Column, alpha: str | Alphabet = DNA) -> Column:
    """Bit-set state of each residue; for DNA the canonical index is the state."""
    return cstate_to_pstate(encode_cstate(seq, alpha), alpha)


def decode_cstate(cstates: Column, alpha: str | Alphabet = DNA) -> Column:
    symbols = F.lit(alphabet(alpha).symbols)
    return F.array_join(F.transform(cstates, lambda k: F.substr(symbols, k + 1, F.lit(1))), "")


def decode_pstate(states: Column, alpha: str | Alphabet = DNA) -> Column:
    """State -> residue; an AA state without a symbol becomes ``X``."""
    a = alphabet(alpha)
    if a.name == "dna":
        return decode_cstate(states, a)
    known = F.create_map(*[F.lit(x) for s, c in zip(a.states, a.symbols) for x in (s, c)])
    return F.array_join(
        F.transform(states, lambda s: F.coalesce(F.element_at(known, s), F.lit("X"))), ""
    )


def is_gap(c: Column, alpha: str | Alphabet = DNA) -> Column:
    return normalize_seq(c, alpha) == F.lit("-")


def is_single(c: Column, alpha: str | Alphabet = DNA) -> Column:
    return F.lit(alphabet(alpha).residues()).contains(normalize_seq(c, alpha)) & (c != "")


def is_known(c: Column, alpha: str | Alphabet = DNA) -> Column:
    return F.lit(alphabet(alpha).symbols).contains(c) & (c != "")


def nongap_map(seq: Column, alpha: str | Alphabet = DNA) -> Column:
    """Alignment columns (0-based) of the non-gap residues, in order."""
    marked = F.transform(
        chars(normalize_seq(seq, alpha)),
        lambda c, i: F.when(c == "-", F.lit(-1)).otherwise(i),
    )
    return F.filter(marked, lambda i: i >= 0)


def gap_count(seq: Column, alpha: str | Alphabet = DNA) -> Column:
    return F.length(seq) - F.length(F.regexp_replace(normalize_seq(seq, alpha), "-", ""))


def row_of_cells(cells: Column, width: Column) -> Column:
    """Row text of a sorted array of ``(col, ch)`` with distinct columns: ``-`` elsewhere, so the work is that of the cells."""
    before = lambda i: F.coalesce(F.get(cells, i)["col"], F.lit(-1))
    piece = lambda x, i: F.concat(F.repeat(F.lit("-"), x["col"] - before(i - 1) - 1), x["ch"])
    tail = F.repeat(F.lit("-"), width - 1 - before(F.size(cells) - 1))
    return F.concat(F.array_join(F.transform(cells, piece), ""), tail)


def map_states(seq: Column, symbols: str) -> Column:
    """Positions in ``symbols`` of the residues that occur there; others are dropped."""
    src = F.lit(symbols)
    return F.filter(
        F.transform(chars(F.translate(seq, LOWER, UPPER)), lambda c: F.instr(src, c) - 1),
        lambda k: k >= 0,
    )
