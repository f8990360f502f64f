import random
from collections import defaultdict

from conftest import ROWS
from pyspark.sql import functions as F

from nearfield.llm import line_dedup as L


def sets(text):
    return [frozenset(w for w in line.lower().translate(str.maketrans("\t\x0b\f\r", "    ")).split(" ") if w) for line in (text or "").split("\n")]


def brute(rows):
    """Kept lines by document, with every line held against every earlier one."""
    documents = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    before, kept = [], {}
    for i, t in documents:
        kept[i, t] = []
        for number, s in enumerate(sets(t)):
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in before):
                kept[i, t].append(number)
            if s:
                before.append(s)
    return kept


def check(spark, df, rows):
    got = defaultdict(list)
    for r in L.deduplicate(df).collect():
        got[r.doc_id].append(list(r.kept))
    expected = defaultdict(list)
    kept = brute(rows)
    for i, t in rows:
        expected[i].append(kept[i, t or ""])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_messy_rows(spark, messy):
    rows = [r for r in ROWS if r[0] is not None]  # two null keys with different texts have no brute-force order
    check(spark, messy.where("doc_id IS NOT NULL"), rows)
    assert L.deduplicate(messy).count() == len(ROWS)


def test_groups_of_near_copies_and_ties(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    origin = rng.sample(vocabulary, 25)
    rows = []
    for i in range(120):
        near = list(origin)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(25)] = rng.choice(vocabulary)
        rows.append((i, " ".join(near) + "\n" + " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) + "\n\n" + " ".join(rng.sample(vocabulary, 3))))
    check(spark, spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), rows)


def test_texts_without_the_lines(spark, messy, nothing):
    out = L.remove_lines(messy)
    assert out.columns == messy.columns and out.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert texts[2] == "" and texts[3] == "something else entirely is written on this line" and texts[8] is None and texts[4] == ""
    assert L.deduplicate(nothing).count() == 0 and L.remove_lines(nothing).count() == 0


def test_texts_of_one_key_that_share_a_short_hash(spark):
    """Two texts with one key and one 32-bit hash stay apart: each keeps its own lines."""
    one = "a single line with the number 832"
    three = "first of three 337269\nsecond of them 337269\nthe last one ends 337269"
    for key in (7, None):
        docs = spark.createDataFrame([(key, one), (key, three)], "doc_id BIGINT, text STRING")
        assert docs.select(F.hash("text")).distinct().count() == 1
        assert sorted(list(r.kept) for r in L.deduplicate(docs).collect()) == [[0], [0, 1, 2]]
        assert sorted(r.text for r in L.remove_lines(docs).collect()) == [one, three]


def test_lines_of_one_template(spark):
    """Lines that share all words but their own one meet in no list unless they can match."""
    rows = [(i, f"alpha beta gamma delta u{i}\nalpha beta gamma delta epsilon zeta eta u{i}\nalpha beta gamma delta epsilon zeta eta theta iota v{i // 2}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    check(spark, docs, rows)
    short = spark.createDataFrame([(i, f"alpha beta gamma delta u{i}") for i in range(2000)], "doc_id BIGINT, text STRING")
    sets = L._sets(L._identified(short, "doc_id", "text"))
    direct, rest = L._candidates(L._postings(sets, L._crowded(sets)))
    assert direct.count() == 0 and rest.count() == 0


def test_long_lists_are_split_by_later_words(spark, monkeypatch):
    """The result does not depend on which keys are split."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        line = rng.sample(vocabulary, rng.randint(1, 24))
        near = [w for w in line if rng.random() > 0.06] + rng.sample(vocabulary, rng.randint(0, 2))
        rows.append((i, " ".join(line) + "\n" + " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for limit in (0, 200, 10**9):
        monkeypatch.setattr(L, "LONG", limit)
        check(spark, docs, rows)


def test_a_pair_is_formed_once_for_a_run_of_shared_words(spark):
    """Lines whose rare words are all shared meet in several lists; one of them gives the pair."""
    rows = [(i, " ".join(f"r{i}x{j}" for j in range(16)) + (" one two" if i < 50 else "")) for i in range(50)]
    rows += [(100 + i, rows[i][1].replace("one two", "three four")) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    check(spark, docs, rows)
    sets = L._sets(L._identified(docs, "doc_id", "text"))
    direct, rest = L._candidates(L._postings(sets, L._crowded(sets)))
    pairs = rest.count()
    assert direct.count() + pairs >= 50 and pairs == rest.distinct().count()


def test_texts_are_not_shuffled_for_few_shortened_documents(spark):
    docs = spark.createDataFrame([(i, f"one line with a number {i}\nthe same words on this line of all") for i in range(40)], "doc_id BIGINT, text STRING")
    out = L.remove_lines(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.doc_id, r.text) for r in out.collect())[1] == (1, "one line with a number 1")


def test_no_pattern_runs_over_texts_and_no_frame_grows_with_its_list(spark):
    docs = spark.createDataFrame([(1, "one\ttwo three\nfour\x0bfive"), (2, "one two\rthree\nsix")], "doc_id BIGINT, text STRING")
    rows = L._identified(docs, "doc_id", "text")
    sets = L._sets(rows)
    assert "rlike" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    plan = L._meetings(L._postings(sets, L._crowded(sets)))._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "RowFrame" in plan
    assert sorted((r.doc_id, list(r.kept)) for r in L.deduplicate(docs).collect()) == [(1, [0, 1]), (2, [1])]
