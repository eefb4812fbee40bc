import random

import pytest


def prose(rng, n, words=400):
    """n words of a small invented vocabulary."""
    return " ".join(f"w{int(rng.paretovariate(0.6)) % words}{'aeiou'[rng.randrange(5)]}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows (doc_id, text, lang, source, size) with copies, near copies, shared passages, nulls, blanks, one long word,
    repeated rows and an extra column whose name clashes with names that operators use."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([2, 9, 40, 120, 300])) for _ in range(120)]
    passage = prose(rng, 120)
    texts += [texts[3], texts[3], texts[7], texts[9] + " tail"]
    for i in range(30):  # near copies of one text
        words = texts[11].split() if len(texts[11].split()) > 30 else passage.split()
        words = list(words)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [prose(rng, 30) + "\n" + passage + "\nshared line of the site\n" + prose(rng, 20) for _ in range(15)]
    texts += [None, "", "   \n\t ", "one", "two words", "x" * 5000, "é" * 700 + " ß", "same " * 300, prose(rng, 3000)]
    rows = [(i, t, "en", None if i % 17 == 0 else f"src{i % 3 if i % 2 else 0}", i * 1.5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[20], None, "src0", None), (None, texts[20], "de", "src1", 2.0), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, size double"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
