"""The registered queries and the pipeline, against SQL or brute force over the small tables."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tesserae.llm import queries
from tesserae.llm.common import documents

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(map(plain, r)) for r in df.select(*columns).collect()) == Counter(tuple(map(plain, r)) for r in found.fetchall())


def test_names_and_contracts(spark, sf_dir):
    plans = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in plans) == list(range(1, 11))
    wanted = {
        "op4": "doc_id bigint n_bytes bigint n_tokens bigint over_limit boolean",
        "op5": "doc_id bigint size bigint source_size bigint target double taken bigint",
        "op6": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string",
        "op7": "doc_id bigint fingerprint string component_id bigint",
        "op8": "vec_id bigint n_links bigint component_id bigint kept boolean",
        "op9": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean",
        "op10": "doc_id bigint start bigint n_tokens bigint ids_crc32 bigint",
    }
    for name, plan in plans.items():
        key = name.split("_")[0]
        if key in wanted:
            words = wanted[key].split()
            kinds = dict(plan(spark, sf_dir).dtypes)
            assert {c: kinds[c] for c in words[::2]} == dict(zip(words[::2], words[1::2])), name


def test_stages_on_odd_tables(spark, odd, empty, sf_dir):
    """Nulls, repeats, long texts and columns named like helpers, one stage at a time and all together; empty tables."""
    ids = {r.doc_id for r in odd.select("doc_id").collect()}
    together = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        alone = stage(spark, odd, sf_dir)
        assert alone.columns == odd.columns and {r.doc_id for r in alone.select("doc_id").collect()} <= ids, name
        none = stage(spark, empty, sf_dir)
        assert none.columns == odd.columns and none.count() == 0, name
        together = stage(spark, together, sf_dir).cache()
        assert together.columns == odd.columns, name
    last = corpus_pipeline.encode(spark, together, sf_dir)
    assert last.count() == together.count() and corpus_pipeline.encode(spark, empty, sf_dir).count() == 0
    assert together.where("text IS NULL OR trim(text) = ''").isEmpty() and together.where("doc_id = 8").count() >= 1
    seconds = corpus_pipeline.near_duplicates(spark, odd, sf_dir).select("doc_id", "text").collect()
    assert sum(not (r.text or "").strip() for r in seconds) == 1  # all blank texts are one group


def test_pipeline(spark, sf_dir):
    """Each stage by itself is held against brute force elsewhere; here their order, columns and effects."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mix", "encode"]
    docs = documents(spark, sf_dir)
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = docs.cache()
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2]
    assert docs.where("text rlike 'password=[0-9a-f]{18}|AKIA[A-Z0-9]{16}'").isEmpty()
    want = Counter(tuple(r) for r in corpus_pipeline.encode(spark, docs, sf_dir).collect())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
