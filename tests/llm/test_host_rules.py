"""Counts against plain loops, and verdicts by host."""

import random
import re

from flightlens.llm import host_rules

WHITE = " \t\n\x0b\x0c\r"


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def check(df, docs):
    judged, hosts = host_rules.judge(df)
    got = [(r.did, r.sig, *(r[c] for c in host_rules.COUNTS), r.base_failed) for r in judged.collect()]
    keys = df.selectExpr("doc_id", "text", "coalesce(doc_id, 9223372036854775807) d", "xxhash64(text) s").collect()
    want = []
    for r in keys:
        c = counted(r.text)
        want.append((r.d, r.s, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted(got) == sorted(want)
    return judged, hosts


def test_random_texts(spark, rows):
    draw = random.Random(5)
    word = lambda: draw.choice(["a", "b", "c#", "Éé", "long*word", f"x{draw.randint(0, 300)}"])
    docs = [(i, "".join(word() + draw.choice([" ", "\t", "\n", "  ", "\n\n"]) for _ in range(draw.randint(0, 120))), f"h{i % 4}") for i in range(80)]
    check(rows("doc_id long, text string, source string", *docs), docs)


def test_edges(spark, rows):
    once = " ".join(f"word{k}" for k in range(60))
    docs = [(1, None, "h"), (2, "", None), (None, once, None), (3, once + "\n" + once, "h"), (4, "a a a", "h"), (5, "x " * 30_000, "h"), (6, " \n\t ", ""), (7, once, "h"), (7, once, "h")]
    df = rows("doc_id long, text string, source string, n_words string, host string", *[(*x, "n", "m") for x in docs])
    judged, _ = check(df, docs)
    kept = {(r.did, r.kept) for r in judged.collect()}
    assert {(2**63 - 1, True), (7, True), (1, False), (2, False), (3, False), (5, False)} <= kept
    out = host_rules.keep(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 7, 7]
    assert host_rules.keep(df.limit(0)).collect() == [] and host_rules.judge(df.limit(0))[1].collect() == []


def test_a_host_of_junk_goes_as_a_whole_but_chance_does_not_count(spark, rows):
    good = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    junk = lambda k: good(k).replace("x1", "###")
    docs = [(k, good(k), f"fine{k % 8}") for k in range(160)]
    docs += [(200 + k, junk(k), "bad") for k in range(60)] + [(300, good(300), "bad")]
    docs += [(400, junk(400), "tiny")]
    docs += [(401, good(401), "small"), (402, junk(402), "small")]
    df = rows("doc_id long, text string, source string", *docs)
    _, hosts = host_rules.judge(df)
    by = {r.host: r for r in hosts.collect()}
    assert not by["bad"].host_ok and by["fine0"].host_ok and by["small"].host_ok
    assert by["tiny"].symbols_rate < 1.0  # one failure of one document is drawn to the others
    left = {r.doc_id for r in host_rules.keep(df).collect()}
    assert left == {*range(160), 401}
