import random

from packetlog.llm import linededup


def brute(rows, percent=80):
    """Lines removed per (doc_id, text), comparing every line with all earlier ones."""
    places = sorted({(i is not None, i or 0, linededup_key(t), i, t) for i, t in rows if t is not None}, key=lambda x: x[:3])
    lines = [(d, n, frozenset(w for w in line.lower().split() if w)) for d, (_, _, _, i, t) in enumerate(places) for n, line in enumerate(t.split("\n"))]
    gone = {}
    for k, (d, n, w) in enumerate(lines):
        if w and any(v and len(v & w) * 100 >= len(v | w) * percent for _, _, v in lines[:k]):
            gone.setdefault(places[d][3:], set()).add(n)
    return gone


KEYS = {}


def linededup_key(text):
    return KEYS[text]


def clean(text, gone):
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def check(spark, table, rows):
    from packetlog.llm import common as C
    KEYS.update({r.text: r.k for r in table.select("text", C.text_hash().alias("k")).collect()})
    gone = brute(rows)
    found = linededup.dedup_lines(table)
    got = sorted([(r.doc_id, r.text, r["__removed"]) for r in found.collect()], key=str)
    want = sorted([(i, None if t is None else clean(t, gone.get((i, t), ())), len(gone.get((i, t), ()))) for i, t in rows], key=str)
    assert got == want
    return gone


def test_against_brute_force(spark, docs):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(60)]

    def variant(line):
        parts = line.split(" ")
        for _ in range(rng.randint(0, 3)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        return rng.choice([" ".join(parts), " ".join(reversed(parts)), "\t".join(parts).upper()])

    rows = [(k, "\n".join(variant(rng.choice(lines)) for _ in range(rng.randint(0, 8)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n \n"), (3, rows[3][1]), (3, "another text\nof the same id"), (None, lines[0] + "\n" + lines[1])]
    assert check(spark, docs(rows), rows)


def test_hot_lines_and_near_copies(spark, docs):
    words = [f"v{k}" for k in range(40)]
    rows = [(k, "the hot line of all\n" + " ".join(words[:37] + [f"x{k}", f"y{k}"])) for k in range(60)]
    rows += [(100, " ".join(f"z{k}" for k in range(4000)) + "\nshort"), (101, " ".join(f"z{k}" for k in range(100, 4000)))]
    gone = check(spark, docs(rows), rows)
    assert len(gone) == 60  # all but the first document lose lines, and the long line's match


def test_columns_and_empty(spark, docs, empty):
    table = docs(["a b c d\na b c d", "x"])
    assert linededup.dedup_lines(table).columns == [*table.columns, "__lines", "__removed"]
    assert linededup.dedup_lines(empty).count() == 0


def test_native_plan(spark, docs):
    plan = linededup.dedup_lines(docs(["a b c d e\na b c d e"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_lines_at_lower_thresholds(spark, docs):
    for percent, left in ((75, ["a b c", ""]), (80, ["a b c", "a b c d"])):
        found = linededup.dedup_lines(docs(["a b c", "a b c d"]), percent).orderBy("doc_id").collect()
        assert [r.text for r in found] == left


def test_heavy_tokens_and_salted_windows(spark, docs, monkeypatch):
    """Pairs of heavy tokens as keys and salted windows give the same lines."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(14)]
    rows = [(k, "\n".join(" ".join(rng.sample(words, rng.randint(3, 12))) for _ in range(3))) for k in range(70)]
    monkeypatch.setattr(linededup, "WINDOW", 2)
    for heavy in (3, 7):
        monkeypatch.setattr(linededup, "HEAVY", heavy)
        assert check(spark, docs(rows), rows)


def test_own_output_again(spark, docs):
    """Its own output, with the columns it adds, is a table like any other."""
    once = linededup.dedup_lines(docs(["a b c d\na b c d", "x y\nx y z"]))
    again = linededup.dedup_lines(once)
    assert again.columns == once.columns
    assert sorted(r.text for r in again.collect()) == sorted(r.text for r in once.collect())


def test_parities_of_short_and_long_sets(spark, docs, monkeypatch):
    """Short sets keep 64 bits only; the filter stays exact where both kinds meet.
    The bitmaps need no broadcast."""
    def refuse(_):
        raise AssertionError("broadcast")

    monkeypatch.setattr(linededup.F, "broadcast", refuse)
    monkeypatch.setattr(linededup, "LONG", 6, raising=False)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    lines = [rng.sample(words, rng.randint(4, 12)) for _ in range(12)]
    rows = [(k, " ".join(line + rng.sample(words, k % 3))) for k, line in enumerate(lines * 4)]
    assert check(spark, docs(rows), rows)
    sets = linededup._sets(docs(rows), 80).collect()
    assert {r.n > 6 for r in sets} == {True, False}
    assert all(r.p2 == 0 and (r.p1 % 2**64).bit_count() <= r.n for r in sets if r.n <= 6) and any(r.p2 for r in sets if r.n > 6)


def test_words_are_compared_once(spark, docs, monkeypatch):
    """No filter makes a line's token hashes, or a pair's shared words, a second time."""
    plans, stage = [], linededup.C.stage

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df)

    monkeypatch.setattr(linededup.C, "stage", seen)
    found = linededup.dedup_lines(docs(["a b c d e\n \t\n\x0b", "a b c d e f", "\na\tb C d E"])).orderBy("doc_id").collect()
    assert [(r.text, r["__lines"], r["__removed"]) for r in found] == [("a b c d e\n \t\n\x0b", 3, 0), ("", 1, 1), ("", 2, 1)]
    assert [p.count("array_distinct(") for p in plans if "array_distinct(" in p and "array_intersect(" not in p] == [1]
    assert [p.count("array_intersect(") for p in plans if "array_intersect(" in p] == [1, 1]
