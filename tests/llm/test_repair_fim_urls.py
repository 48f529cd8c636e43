import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import plain
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import fim, queries, turns, urls
from granary.llm.common import keep
from granary.plans.checks import facts

SQL = queries.oracle_sql()


def by_sql(name, table, rows, columns):
    """Rows of a query's SQL on a table of its own."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} ({', '.join(f'{c} {t}' for c, t in columns)})")
    if rows:
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})", rows)
    found = con.execute(SQL[name])
    return plain(found.fetchall(), [d[0] for d in found.description])


def of(df):
    return plain([tuple(r) for r in df.collect()], df.columns)


# conversations


def brute(rows):
    """(cost, audit) by all edit sequences with at most two insertions at each place."""
    best = None
    places = [["D"] if gone else ["K", "R", "D"] for _, gone, _ in rows]
    for edits in itertools.product(*places):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            state, cost, audit = 0, 0, ""

            def insert(n):
                nonlocal state, cost, audit
                for _ in range(n):
                    state, cost, audit = turns.NEXT[state], cost + 3, audit + "I"

            insert(inserts[0])
            for (initial, _, truncated), edit, n in zip(rows, edits, inserts[1:], strict=True):
                audit += edit
                if edit == "D":
                    cost += 4
                elif edit == "R":
                    state, cost = turns.NEXT[state], cost + 3 + 3 * truncated
                else:
                    state, cost = turns.STEP.get((state, initial)), cost + 3 * truncated
                    if state is None:
                        break
                insert(n)
            if state in (0, 3) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_equals_all_edit_sequences():
    draw = random.Random(5)
    for _ in range(150):
        rows = [(draw.choice("suatx"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, 4))]
        [(_, audit, cost, _)] = turns.search(rows, [(0, 0)], True)
        assert (cost, audit) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_segments_do_not_matter(monkeypatch, size):
    draw = random.Random(size)
    for _ in range(60):
        rows = [(i // 2, draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice(["a.", "b", "", "c!"]), draw.random() < 0.7) for i in range(draw.randint(0, 30))]

        def report():
            one = turns.Conversation(1)
            for row in rows:
                one.add(*row)
            return one.report()

        monkeypatch.setattr(turns, "SEGMENT_ROWS", 256)
        whole = report()
        monkeypatch.setattr(turns, "SEGMENT_ROWS", size)
        assert report() == whole


def test_long_conversations_take_linear_memory():
    import tracemalloc

    one = turns.Conversation(1)
    tracemalloc.start()
    for i in range(20_000):
        one.add(i, "assistant" if i % 2 else "user", f"turn {i}.", True)
    report = one.report()
    assert report["audit"] == "K" * 20_000 and report["cost"] == 0
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


TURNS = [
    (1, 0, "system", "s."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Well"), (1, 2, "assistant", "Well"), (1, 5, None, None),
    (2, None, "user", "x."), (2, None, "user", "y!"), (2, 3, "", "z?"), (None, None, None, None), (None, 4, "user", "q."),
    (3, 1, "user", "a."), (3, 1, "user", "a."), (3, 1, "user", "a."), (4, 0, "tool", "data."), (4, 1, "user", "tail \n"), (5, 0, "Üser", "été."),
    *[(6, i, "user" if i % 2 else "assistant", f"{i} " + "long text. " * 2000) for i in range(9)],
    *[(c, t, r, "One. Two! " + r) for c in range(7, 60) for t, r in enumerate(("user", "assistant", "system", "user", "assistant"))],
]


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, digest string").withColumnRenamed("digest", "kind")


def test_repairs_equal_sql_on_odd_rows(spark):
    rows = turn_table(spark, TURNS)
    columns = [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "VARCHAR"), ("text", "VARCHAR")]
    for n in (1, 5):
        some = rows.repartition(n)
        assert of(turns.repairs(turns.damaged(some), some.select("conv_id"))) == by_sql("op11_turn_repair", "conversations", TURNS, columns)
    none = rows.limit(0)
    assert turns.repairs(turns.damaged(none), none.select("conv_id")).collect() == []


def test_repaired_turns_have_the_reported_hash(spark):
    rows = turns.damaged(turn_table(spark, TURNS))
    reports = keep(turns.repairs(rows))
    texts = {}
    for r in sorted(turns.repaired(rows, reports).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["place"]) if r["conv_id"] is not None else (False, 0, r["place"])):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert r["role"][0] in "sua"
    for r in reports.collect():
        assert hashlib.sha256("\n".join(texts.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in texts.get(r["conv_id"], [])))


# fill in the middle


@given(st.text(alphabet=st.sampled_from("abZ é中\n.😀1"), max_size=300))
@settings(max_examples=150, deadline=None)
def test_ends_and_lists(text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    at = list(itertools.accumulate(map(len, tokens)))
    assert fim.ends(text).tolist() == at
    blob = fim.encode(fim.ends(text))
    assert [fim.select(blob, k) for k in range(len(at) + 1)] == [0, *at]


@pytest.mark.parametrize("gaps", [[1] * 5000, [1, 900_000, 1, 1], [7] * 3000 + [2_000_000] + [1] * 2000, list(range(1, 800))])
def test_lists_of_uneven_gaps(gaps):
    at = np.cumsum(gaps)
    blob = fim.encode(at)
    assert [fim.select(blob, k) for k in range(1, len(at) + 1)] == at.tolist()
    assert len(blob) <= 9 + len(at) * (2 + np.log2(at[-1] / len(at)) + 2) / 8 + 8 * (len(at) // fim.SAMPLE + 1) + 2


FIM = [
    (1, "Plain words here."), (2, ""), (3, None), (None, "no id at all"), (4, "has <P> in it"), (5, "a<S"), (6, "<<M"), (7, "été 中文 😀 mixed\n\nlines"), (8, "x" * 50_000),
    (9, "9 " * 20_000), *[(i, "many copies of one text, <S and so on") for i in range(100, 400)], (100, "a repeated id"), *[(i, f"text {i} < P> " + "word " * (i % 7)) for i in range(400, 500)],
]


def test_cuts_equal_sql_on_odd_rows(spark):
    rows = spark.createDataFrame([(*r, b"x", 3) for r in FIM], "doc_id long, text string, key binary, n int")
    for n in (1, 6):
        made = fim.transformed(rows.repartition(n))
        assert of(fim.digests(made)) == by_sql("op12_fill_in_middle", "documents", FIM, [("doc_id", "BIGINT"), ("text", "VARCHAR")])
    back = made.select("doc_id", fim.restored(made["output"], made["form"]).alias("text"))
    assert sorted(map(repr, ((r[0], r[1] or "") for r in FIM))) == sorted(repr((r[0], r[1])) for r in back.collect())
    assert fim.transformed(rows.limit(0)).collect() == []


def test_each_text_is_listed_once_for_each_part(spark, monkeypatch):
    monkeypatch.setattr(fim, "MOST", 100)
    rows = fim.keyed(spark.createDataFrame(FIM, "doc_id long, text string").repartition(5))
    lists = fim.index(rows)
    texts = {t or "" for _, t in FIM}
    assert lists.select("key", "size").distinct().count() == len(texts) and lists.count() == len(texts) + 2  # 300 copies of one text
    assert of(fim.digests(fim.transformed(spark.createDataFrame(FIM, "doc_id long, text string")))) == by_sql("op12_fill_in_middle", "documents", FIM, [("doc_id", "BIGINT"), ("text", "VARCHAR")])


# urls


def test_cascade_is_exact(spark):
    keys = spark.range(60_000).selectExpr("concat('host-', id) AS key")
    for every in (1, 7, 2000, 70_000):
        listed = keys.where(f"substring(key, 6) % {every} = 0") if every > 1 else keys
        known = urls.universe(keys, listed)
        n = listed.count()
        levels = urls.cascade(known, n, 60_000 - n)
        one, two = urls.hashes(keys["key"])
        got = keys.select("key", one.alias("one"), two.alias("two")).toPandas()
        found = urls.member(levels, got["one"].to_numpy().view(np.uint64), got["two"].to_numpy().view(np.uint64))
        assert (found == (got["key"].str[5:].astype(int) % every == 0)).all()
        assert sum(x.bits for x in levels) <= urls.bits(n, 60_000 - n) + 64 * len(levels)


def test_an_empty_list_blocks_nothing(spark):
    assert urls.cascade(urls.universe(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "key string")), 0, 1) == []


URLS = [
    "http://a.spam-farm.example.com/x", "HTTP://SPAM-FARM.EXAMPLE.COM?q", "http://notspam-farm.example.com/", "http://x.example.net/en/1", "http://x.example.net/fr/1", "http://example.net",
    "https://xexample.net/en/", "http://example.com/de", "http://example.com/de/1", "http://sub.example.com/de/?x", "https://cheap-pills.example.org/fr/3#top", "https://cheap-pills.example.org/de/3#top",
    "", None, "no scheme/en/", "a://b://c/d", "://", "http:///path", "http://net/", "http://net", "http://ÉCOLE.net/é", "http://.net/", "http://net./",
    "http://" + "a." * 3000 + "free-bets.example.org/p" + "q" * 50_000, "http://" + "b" * 5000 + ".free-bets.example.org", "http://user@free-bets.example.org:80/",
    "http://line\nbreak.casino-win.example.org/a\nb?c",
]


@pytest.mark.parametrize("most_bits", [urls.MOST_BITS, 0])
def test_verdicts_equal_sql_on_odd_rows(spark, most_bits):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])]
    pages = spark.createDataFrame([(*r, "h", True) for r in rows], "page_id long, url string, host string, hit boolean")
    got = of(urls.judged(pages, most_bits=most_bits))
    assert got == by_sql("op13_url_cascade", "pages", rows, [("page_id", "BIGINT"), ("url", "VARCHAR")])
    assert urls.judged(pages.limit(0), most_bits=most_bits).collect() == []


def test_lists_and_rules_are_parameters(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x"), (2, "http://b.c/x"), (3, "http://c/x")], "page_id long, url string")
    listed = spark.createDataFrame([("B.c",), (None,), ("",)], "key string")
    assert [r["verdict"] for r in urls.judged(pages, listed, [("allow", "a.b.c", "/")]).orderBy("page_id").collect()] == ["allow", "block", "allow"]
    assert {r["verdict"] for r in urls.judged(pages, listed.limit(0).where("false"), []).collect()} == {"allow"}


def test_membership_takes_no_join(spark, data):
    plan = queries.queries()["op13_url_cascade"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert facts(queries.queries()["op13_url_cascade"](spark, data))["columns"] == {"page_id", "url"}
