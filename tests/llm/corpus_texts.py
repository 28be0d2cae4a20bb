def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))
