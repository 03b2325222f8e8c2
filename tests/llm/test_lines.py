from collections import Counter, defaultdict

from lodestrata.llm import lines

SCHEMA = "doc_id long, source string, text string, `__ld_lines` string, h string, l string, lines string, c2 string, `a.b` string"


def brute(rows, ratio=lines.RATIO, least=lines.MIN_PAGES):
    pages, count = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        pages[host or ""] += 1
        count[host or ""].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    bad = lambda h, x: count[h][x.strip(" ")] >= least and count[h][x.strip(" ")] > ratio * pages[h] and x.strip(" ") != ""
    return [None if t is None else "\n".join(x for x in t.split("\n") if not bad(h or "", x)) for _, h, t in rows]


def test_against_brute_force(spark):
    rows = [(i, None if i % 9 == 0 else f"h{i % 3}", None if i % 31 == 0 else "" if i % 29 == 0 else "\n".join(["© site", f" line {i % 40}", "", f"own {i}", "menu " if i % 4 else "menu", "menu"])) for i in range(200)]
    rows += [(7, "h1", "© site")] * 3 + [(None, "h2", "x" * 200_000 + "\n© site")]
    df = spark.createDataFrame([(*r, "keep", "k2", "k3", "k4", "k5", "k6") for r in rows], SCHEMA)
    out = lines.drop_site_lines(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.source, r.text, r.h) for r in out.collect())
    assert got == Counter((r[0], r[1], t, "k2") for r, t in zip(rows, brute(rows), strict=True))


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"h{i % 2}", f"same\nown {i}", 1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, salt int, part int")
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    assert sorted(r.text for r in lines.drop_site_lines(df).collect()) == sorted(f"own {i}" for i in range(40))


def test_small_hosts_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "tiny", "a\nb") for i in range(2)], "doc_id long, source string, text string")
    assert {r.text for r in lines.drop_site_lines(df).collect()} == {"a\nb"}
    assert lines.drop_site_lines(df.limit(0)).count() == 0
