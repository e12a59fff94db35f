import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, extra=False):
        full = [(*r, *("en", "src0")[: max(0, 4 - len(r))], len(r[1] or ""))[:5] for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that operators use themselves
            for c in ("chunk", "fp", "toxicity", "leak", "license", "mix", "mix_pool", "shard", "size", "near_row", "V", "kept"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make


WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)) + "."


EDGE = [(None, None), (None, "same"), (1, ""), (2, None), (3, "   \n\t"), (4, "one"), (4, "one"), (5, "one"), (6, "Ünïcode 漢字 😀 text"), (7, "x " * 30000), (8, "a\n\nb\n" * 200)]
