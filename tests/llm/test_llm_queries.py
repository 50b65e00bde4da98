"""Registered corpus queries against DuckDB; the pipeline against its stages done by hand."""

import duckdb
import pytest
from check_queries import compare, connect

import corpus_pipeline
from statframe.llm import queries, unigram
from statframe.llm.codec import MODEL
from statframe.llm.common import keep, read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()) is None


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_chat_query_equals_the_table(spark, con):
    got = queries.QUERIES["op2_chat"](spark, SF).toPandas()
    want = con.execute("""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select * from (values (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')))
        select conv_id::bigint as conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
               coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256 from c group by conv_id""").df()
    assert compare(got.drop(columns="formatted_chars"), want) is None and (got["formatted_chars"] >= got["loss_chars"]).all()


def test_token_queries_agree_and_decode(spark, con):
    v = unigram.load(MODEL)
    counts = queries.QUERIES["op7_token_counts"](spark, SF).toPandas().set_index("doc_id")
    got = queries.QUERIES["op8_sentencepiece"](spark, SF).toPandas().set_index("doc_id")
    sums = dict(con.execute("select doc_id, sha256(coalesce(text, '')) from documents").fetchall())
    assert dict(got["decoded_sha256"]) == sums and (counts["n_tokens"] == got["n_tokens"]).all()
    for doc_id, text in con.execute("select doc_id, text from documents where length(text) < 3000 limit 40").fetchall():
        whole = unigram.SPACE + unigram.normal(text)
        assert list(got.loc[doc_id, "ids"]) == unigram.trace(v, whole, unigram.segment(v, whole)[1], len(whole))[0]


@pytest.mark.parametrize("name, columns", [("op3_language", ["doc_id", "held_out", "lang_pred", "score"]), ("op5_quality", ["doc_id", "held_out", "score", "predicted"])])
def test_model_queries_return_every_document(spark, con, name, columns):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert list(got.columns) == columns and got["score"].between(0, 1).all()
    assert sorted(got["doc_id"]) == sorted(x for x, in con.execute("select doc_id from documents").fetchall())


def test_pipeline_stages_take_effect(spark, con):
    docs = read(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, SF))
        seen.append((name, before, docs))
    assert all(after.columns == columns for _, _, after in seen[:-1])
    table = lambda df: df.toPandas()
    (_, _, scored), (_, lines_in, lines_out), (_, copies_in, copies_out), (_, bench_in, bench_out), (_, enc_in, enc_out) = seen
    own = duckdb.connect()
    for sql, source, key in ((queries.OP1_SQL, lines_in, "lines"), (queries.OP9_SQL, copies_in, "copies"), (queries.OP4_SQL, bench_in, "bench")):
        own.register("documents", table(source))
        own.register("benchmark", con.execute("select * from benchmark").df())
        own.execute(f"create table {key} as {sql}")
        own.unregister("documents")
    sums = {d: s for d, s in own.execute("select doc_id, kept_sha256 from lines").fetchall()}
    out = table(lines_out.selectExpr("doc_id", "sha2(text, 256) as s", "n_chars = length(text) as ok"))
    assert dict(zip(out["doc_id"], out["s"])) == sums and out["ok"].all()
    assert sorted(table(copies_out)["doc_id"]) == sorted(x for x, in own.execute("select doc_id from copies where component_id = doc_id").fetchall())
    assert sorted(table(bench_out)["doc_id"]) == sorted(x for x, in own.execute("select doc_id from bench where not contaminated").fetchall())
    assert 0 < scored.count() < read(spark, SF, "documents").count() and sorted(table(enc_out)["doc_id"]) == sorted(table(enc_in)["doc_id"])


def test_copies_go_by_row_and_at_the_threshold(spark):
    base = [f"w{k}" for k in range(100)]                                                     # 96 shingles of five words
    edited = lambda at: " ".join("edit" if k in at else x for k, x in enumerate(base))       # noqa: E731
    whole, near, far = " ".join(base), edited({20, 60}), edited({10, 45, 80})                # 86 / 106 = 0.811, 81 / 111 = 0.730
    other = " ".join(f"o{k}" for k in range(30))
    data = [(1, whole, "a"), (2, near, "a"), (3, far, "a"), (2, other, "a"), (4, other, "b"), (5, "one two three four five six", "a"),
            (5, "one two three four five six", "a"), (5, "one two three four five six", "b"), (5, "quite another text of seven words here", "a"),
            (None, whole, "a"), (None, whole, "a"), (6, None, "a"), (6, None, "a"), (7, "", "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = sorted(map(tuple, corpus_pipeline.copies(spark, docs, SF).collect()), key=str)
    gone = [(2, near, "a"), (4, other, "b"), (5, "one two three four five six", "a"), (5, "one two three four five six", "b")]
    want = list(data)
    for x in gone:
        want.remove(x)
    assert got == sorted(want, key=str)
