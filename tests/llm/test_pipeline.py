"""The pipeline's stages on the smallest tables, each against plain Python on what the stage before has kept."""

from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from runlore.llm import bpe, quality
from runlore.llm.common import table

from .test_joins import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, tmp_path):
    docs, kept = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        kept[name], docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        assert name == "encoding" or docs.columns == columns
        kept[f"{name} out"] = docs.collect()

    model = quality.fit_quality(table(spark, SF, "documents"), table(spark, SF, "labels"))
    words, counts = quality.base_counts([r.text for r in kept["quality_rules"]])
    good = (model.probabilities(words) >= 0.5) & (counts["n_words"] >= 50) & (2 * counts["n_repeat_words"] <= counts["n_words"])
    assert Counter(map(tuple, kept["quality_rules out"])) == Counter(tuple(r) for r, ok in zip(kept["quality_rules"], good, strict=True) if ok)
    assert 50 < good.sum() < 200

    pages, holders = Counter(r.source for r in kept["line_dedup"]), defaultdict(set)
    for i, r in enumerate(kept["line_dedup"]):
        for line in r.text.split("\n"):
            holders[r.source, line.strip(" ")].add(i)
    bad = {k for k, v in holders.items() if k[1] and len(v) >= 2 and len(v) > 0.1 * pages[k[0]]}
    cleaned = ["\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad) for r in kept["line_dedup"]]
    expected = Counter((r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(kept["line_dedup"], cleaned, strict=True))
    assert Counter(map(tuple, kept["line_dedup out"])) == expected

    own = kept["near_duplicates"]
    sets, groups = brute([tuple(r) for r in own], 5, 80)
    first = Counter(tuple(own[min(g, key=lambda i: own[i].doc_id)]) for g in groups)
    assert Counter(map(tuple, kept["near_duplicates out"])) == first

    taken = Counter(map(tuple, kept["mixing out"]))
    assert set(taken) <= set(map(tuple, kept["mixing"])) and max(taken.values()) == 2
    size = lambda some: sum(len(r.text.encode().split()) for r in some)
    assert abs(size(kept["mixing out"]) - 1.5 * size(kept["mixing"])) < 0.1 * size(kept["mixing"])

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((r.doc_id, tuple(library.encode_ordinary(r.text))) for r in kept["encoding"])
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in kept["encoding out"]) == expected and all(r.decodes for r in kept["encoding out"])
    again = __spark_entry__.queries()["pipeline"](spark, SF)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in again.collect()) == expected


def test_empty_documents(spark, tmp_path):
    docs = table(spark, SF, "documents").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_rows_of_all_kinds(spark, tmp_path):
    """Nulls in any column, repeated rows, and columns whose names clash with those that stages use."""
    given = [r for r in table(spark, SF, "documents").collect()]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines int, n_removed string, row string, copies double"
    more = lambda i: (i, "x", "row", 0.5)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *more(i)) for i, r in enumerate(given)]
    rows += rows[:3] + [(None, given[5].text, None, None, None, None, None, None, None)] * 2 + [(7, None, "en", "src0", 1, *more(0)), (8, "", None, "src0", None, *more(1))]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert made.columns == docs.columns
            assert rows_of(made, docs.columns) <= rows_of(docs, docs.columns)
        docs = made
    assert docs.count() > 30 and docs.filter("decodes").count() == docs.count()


def rows_of(df, names):
    """The different rows without their texts and lengths, which stages may change."""
    return {tuple(r) for r in df.select(*[f"`{c}`" for c in names if c not in ("text", "n_chars")]).collect()}
