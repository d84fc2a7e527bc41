"""Operators that SQL can express, on the smallest tables and on odd rows; the native ones without Python."""

import duckdb
import pyarrow as pa
import pytest

import brute
from check import TABLES, canonical
from conftest import LONG, collected
from encore.llm import archives, personal, quality, toolcalls
from encore.llm.oracle import ORACLE
from encore.llm.queries import QUERIES

PYTHON = ("Python", "Pandas", "Arrow", "ExistingRDD")


def in_sql(sql, **tables):
    db = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, str):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{t}'")
        else:
            db.register(name, t)
    relation = db.sql(sql)
    columns = sorted(relation.columns)
    return columns, canonical(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def in_spark(table):
    columns = sorted(table.columns)
    return columns, canonical(tuple(r) for r in table.select(columns).collect())


@pytest.mark.parametrize("name", ORACLE)
def test_smallest_tables(spark, small, name):
    assert in_spark(QUERIES[name](spark, small)) == in_sql(ORACLE[name], **{t: f"{small}/{t}.parquet" for t in TABLES})


@pytest.mark.parametrize("name", ["op2_tool_call_linking", "op6_line_rules"])
def test_native_plans(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in PYTHON if p in plan]


def test_quality_of_odd_rows(odd, odd_rows, none):
    held = pa.table({"doc_id": [d for d, _ in odd_rows], "text": [t for _, t in odd_rows]})
    assert in_spark(quality.judged(odd)) == in_sql(quality.SQL, documents=held)
    assert quality.judged(none).collect() == [] and quality.cleaned(none).collect() == []
    assert quality.cleaned(odd).columns == odd.columns


def test_quality_of_all_documents(spark, small, rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = [(d, *brute.quality(t)) for d, t in rows]
    got = quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept")
    assert collected(got) == sorted((d, *m) for d, m, _ in want)
    assert collected(quality.cleaned(docs).select("doc_id", "text")) == sorted((d, t) for d, m, t in want if m[-1])


def test_quality_leaves_plain_prose_alone(spark):
    text = ("The rain had stopped at last, and the children ran out into the wet street.\n"
            "Nobody knew where the old dog had gone; it came home late, tired and very hungry.\n"
            "On Monday we will cook soup with beans, as my aunt has shown us many times before!")
    junk = "\n".join(f"Home | News | {i} | About" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, junk), (3, text + "\n" + "Home | News | Sport | About")],
                                 "doc_id long, text string")
    assert collected(quality.cleaned(docs, min_words=20)) == [(1, text), (3, text)]


def test_archives_of_odd_pages(spark):
    same = "<p>" + "y" * 200
    pages = [(1, "http://a", None), (2, None, same), (3, "u", same), (3, "u", same), (None, "u", same), (5, "u", ""),
             (6, "u\r\nWARC-Type: x", "short"), (7, "u", "short"), (8, "é", LONG), (9, "v", "a\r\n\r\nb" * 40)]
    schema = "page_id long, url string, html string, digest string, first string"
    table = spark.createDataFrame([(*p, "x", None) for p in pages], schema)
    held = pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "html": [p[2] for p in pages]})
    # in SQL the null id compares as null; a row without an id is a revisit like others
    sql = archives.SQL.replace("least <> page_id", "least IS NOT NULL AND least IS DISTINCT FROM page_id")
    assert in_spark(archives.archived(table)) == in_sql(sql, pages=held)
    assert in_spark(archives.archived(table, archive_bytes=200)) == in_sql(sql, pages=held)
    assert archives.archived(table.limit(0)).collect() == []


def test_personal_data_of_all_documents(spark, small, rows):
    texts = dict(rows)
    for d, *counts, sha, spans, added in collected(personal.private_spans(spark.read.parquet(f"{small}/documents.parquet"))):
        base = brute.base_spans(texts[d])
        assert counts == [sum(x[3] == k for x in base) for k in personal.KINDS]
        held = [f"{k}:{a}:{b}" for a, _, b, k in base]
        got = spans.split(",") if spans else []
        assert set(held) <= set(got) and len(got) == len(held) + added


def test_personal_data_of_odd_rows(odd, odd_rows, none):
    import hashlib
    got = collected(personal.private_spans(odd).select("doc_id", "base_sha256"))
    want = [(d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in brute.base_spans(t)).encode()).hexdigest())
            for d, t in odd_rows]
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert personal.private_spans(none).collect() == []


def test_swallowed_spans_are_added(spark):
    """A card number right behind a phone number belongs to one long match, which fails; the method finds it."""
    plain = [(i, f"pay by card 4111111111111111 or call +1 (555) 010-{1000 + i} now") for i in range(40)]
    other = [(100 + i, f"serial {10**13 + 7 * i} of the lot") for i in range(40)]
    hard = [(999, "call +1 (555) 010-4477 4012888888881881 today")]
    docs = spark.createDataFrame(plain + other + hard, "doc_id long, text string")
    got = {r[0]: r for r in personal.private_spans(docs).collect()}
    assert "card:23:39" in got[999].spans
    assert all(not got[100 + i].spans or "card" in got[100 + i].spans for i in range(40))


def test_reliabilities_follow_the_plain_rule(spark):
    """Expectation-maximisation in SQL against the same steps in plain Python."""
    import math
    rows = [("ip", [1, 1, 1, None, None, 1], 60.0), ("ip", [0, 1, 0, None, 0, 1], 25.0), ("ip", [0, 0, 0, 1, None, 0], 9.0)]
    many = [(k, v) for k, v, n in rows for _ in range(int(n))]
    marked = spark.createDataFrame(many, "kind string, votes array<int>")
    got = personal.reliabilities(marked).first().model
    prior, hit, slip = 0.5, [0.8] * 6, [0.2] * 6
    for _ in range(personal.TURNS):
        judged = []
        for _, v, n in rows:
            odds = math.log(prior / (1 - prior))
            for x, h, s in zip(v, hit, slip):
                odds += 0 if x is None else math.log(h / s) if x else math.log((1 - h) / (1 - s))
            judged.append((v, n, 1 / (1 + math.exp(-odds))))
        prior = (sum(n * p for _, n, p in judged) + 1) / (sum(n for _, n, _ in judged) + 2)
        chance = lambda i, f: ((sum(f(n, p) for v, n, p in judged if v[i] == 1) + 1)
                               / (sum(f(n, p) for v, n, p in judged if v[i] is not None) + 2))
        hit = [chance(i, lambda n, p: n * p) for i in range(6)]
        slip = [chance(i, lambda n, p: n * (1 - p)) for i in range(6)]
    assert got.prior == pytest.approx(prior) and got.hit == pytest.approx(hit) and got.slip == pytest.approx(slip)


CALL = "struct<id:string,name:string,arguments:string>"


def test_tool_calls_by_hand(spark):
    rows = [
        (1, 1, "assistant", "", [("a", "count", '{"limit": 1.5, "query": "x"}'), ("b", "search", '{"query":7,"more":1}')], None),
        (1, 2, "tool", "ra", None, "a"), (1, 2, "tool", "rz", None, "a"), (1, 3, "tool", "lost", None, "nobody"),
        (1, 4, "assistant", "", [("c", "count", '{"query":{"$ref":"d"}}'), ("d", "count", '{"query":"","after":{"$ref":"a"}}')], None),
        (1, 5, "assistant", "", [("e", "count", '{"query":{"$ref":"f"}}'), ("f", "count", '{"query":{"$ref":"e"}}')], None),
        (1, 6, "assistant", "", [("a", "nothing", "{}"), ("g", "nothing", "{}"), ("h", "search", "no json"), ("i", "search", None)], None),
        (1, 0, "tool", "early", None, "g"), (None, 1, "assistant", "", [("a", "search", '{"query":"q"}')], None),
        (2, 1, "assistant", "", [(None, "search", '{"query":"q","query":"r"}'), ("x", "search", '{"query":"q"}')], None),
        (2, 1, "assistant", None, [], None), (2, 2, None, None, None, "x"),
    ]
    messages = spark.createDataFrame(
        [(*r, "z") for r in rows],
        f"conv_id long, turn long, role string, text string, tool_calls array<{CALL}>, tool_call_id string, level string")
    out = toolcalls.linked_calls(messages, toolcalls.tool_table(spark))
    got = {(r.conv_id, r.call_id): (r.level, r.status, r.errors, r.n_calls, r.n_results) for r in out.collect()}
    assert got == {
        (1, "a"): (0, "linked", "", 2, 2), (1, "b"): (0, "no result", "type:query,unknown:more", 1, 0),
        (1, "nobody"): (None, "orphan result", None, 0, 1), (1, "c"): (2, "no result", "", 1, 0),
        (1, "d"): (1, "no result", "", 1, 0), (1, "e"): (None, "no result", "cycle", 1, 0),
        (1, "f"): (None, "no result", "cycle", 1, 0), (1, "g"): (0, "early result", "tool", 1, 1),
        (1, "h"): (0, "no result", "json", 1, 0), (1, "i"): (0, "no result", "json", 1, 0),
        (None, "a"): (0, "no result", "", 1, 0), (2, None): (0, "no result", "json", 1, 0), (2, "x"): (0, "linked", "", 1, 1)}
    said = {r.call_id: r.canonical for r in out.collect() if r.conv_id == 1}
    assert said["a"] == '{"arguments":{"limit":1.5,"query":"x"},"id":"a","name":"count","result":"ra"}'
    assert toolcalls.linked_calls(messages.limit(0), toolcalls.tool_table(spark)).collect() == []
