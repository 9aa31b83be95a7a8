"""Nulls, empty and very long texts, repeated rows, clashing names and empty tables, for every operator and stage."""

from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from textloom.llm import batches, decontamination, language_id, pieces, quality, secrets, simhash, token_counts, toxicity, url_filter, vantage  # noqa: E402

LONG = "word and more " * 60_000
ROWS = [(1, None), (2, ""), (3, "\n\n"), (None, "the of and"), (4, "same words here"), (4, "same words here"), (5, "same words here"), (6, LONG), (7, "q" * 200_000), (None, None)]
CLASHES = ["held_out", "score", "digest", "n", "total", "label", "fp", "fingerprint", "component_id", "gone_id", "own_sign", "matched_items", "quality_score", "spans", "n_tokens", "best", "with space", "item_id"]
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(k, t, "en" if at % 2 else "xx", "s", None if t is None else len(t), *("z" for _ in CLASHES)) for at, (k, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k, _ in ROWS if k] + [(99, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word and more word and more"), (None, "none of these words stands anywhere else"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "secrets": lambda d, labels, items: secrets.secret_scan(d),
    "toxicity": lambda d, labels, items: toxicity.toxicity(d, labels),
    "tokens": lambda d, labels, items: token_counts.token_counts(d, BPE),
    "language": lambda d, labels, items: language_id.identify(d),
    "pieces": lambda d, labels, items: pieces.encode_texts(d, PIECES),
    "simhash": lambda d, labels, items: simhash.near_duplicates(d),
    "quality": lambda d, labels, items: quality.quality(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(name, odd, labels, items):
    """Every row has one result, equal texts equal ones; an empty table has none."""
    got = OPERATORS[name](odd, labels, items).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in ROWS)
    same = [tuple(r.asDict().values())[1:] for r in got if r.doc_id == 4]
    assert same[0] == same[1]
    assert OPERATORS[name](odd.limit(0), labels.limit(0), items.limit(0)).collect() == []


STAGES = {
    "quality": (lambda d, labels, items: quality.keep_good(d, labels, threshold=0.0), lambda rows: rows),
    "near duplicates": (lambda d, labels, items: simhash.keep_first(d), lambda rows: [r for r in rows if r[0] is None] + [(1, None), (4, "same words here"), (6, LONG), (7, "q" * 200_000)]),
    "decontamination": (lambda d, labels, items: decontamination.drop_contaminated(d, items), lambda rows: [r for r in rows if r[1] != LONG]),
    "secrets": (lambda d, labels, items: secrets.redact_secrets(d), lambda rows: rows),
    "pieces": (lambda d, labels, items: pieces.encode_texts(d, PIECES).selectExpr("doc_id", "cast(null as string) text"), lambda rows: [(k, None) for k, _ in rows]),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages(name, odd, labels, items):
    """Stages keep all columns of all rows that stay, whatever the columns' names."""
    stage, wanted = STAGES[name]
    kept = stage(odd, labels, items)
    if name != "pieces":
        assert kept.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(wanted(ROWS))
    assert stage(odd.limit(0), labels.limit(0), items.limit(0)).count() == 0


def test_decontamination_rows(spark, odd, items):
    got = sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(odd, items).collect())
    assert got == [(6, 1)]
    assert decontamination.contaminated(odd, items.limit(0)).count() == decontamination.contaminated(odd.limit(0), items).count() == 0
    null = spark.createDataFrame([(None, "word and more word and more")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(odd, null).collect()] == [(6, None)]
    assert 6 not in {r.doc_id for r in decontamination.drop_contaminated(odd, null).collect()}


def test_repeated_ids_are_judged_row_by_row(spark):
    """Rows of one id with different texts are each the first, or not, of their own group."""
    a, b, c = "one text of some words here", "quite another one, of other words", "and a third that nobody else has"
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "y"), (2, b, "y"), (3, b, "z"), (3, c, "z"), (3, c, "w")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, gone_id string"))
    got = [tuple(r) for r in kept.collect()]
    assert sorted(r[:2] for r in got) == [(1, a), (2, b), (3, c)]
    assert sorted(tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows[::-1], kept.schema)).collect()) == sorted(got)


def test_urls(spark):
    long = "http://h.net/" + "a/" * 100_000
    rows = [(1, None), (1, None), (None, "http://x.com/?a"), (2, long), (3, "")]
    pages = spark.createDataFrame([(k, u, "z", 1.0, "y") for k, u in rows], "page_id long, url string, host string, f_length double, `a b` string")
    got = url_filter.filter_urls(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(k for k, _ in rows)
    assert {(r.host, r.rule, r.verdict) for r in got if r.page_id == 2} == {("h.net", "net/", "block")}
    assert {(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id == 1} == {("", "", None, "allow")}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_empty_vectors(spark):
    assert vantage.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, query_id int")).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (20, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert vantage.nearest(one).count() == 0


def test_tables_go_to_the_shared_folder_only(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        batches.shared_folder(Elsewhere)
    table, path = batches.stored(spark.range(3))
    assert table.count() == 3
    batches.drop_stored(spark, path)
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path)


def test_a_stage_leaves_its_result_only(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    before = set(batches._held)
    kept, path = batches.stored_alone(spark, lambda: simhash.keep_first(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and set(batches._held) - before == {path}
    batches.drop_stored(spark, path)
