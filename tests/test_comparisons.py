"""Digests, variants and blocks against plain versions."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import blocks
from tessella.operators import digests, evaluation, lexical, variants
from tessella.plans import comparisons


def test_a_digest_is_of_the_rows_and_not_of_their_order(spark):
    rows = [(k, None if k % 5 == 0 else f"text {k % 7}", k % 3) for k in range(400)]
    table = spark.createDataFrame(rows, "k long, t string, g int")
    digest = lambda df: digests.table_digest(df).first()["digest"]
    whole = digest(table)
    for other in (table.repartition(7), table.orderBy(F.desc("k")), table.select("g", "t", "k"), table.where("k < 100").union(table.where("k >= 100"))):
        assert digest(other) == whole
    for other in (table.where("k <> 7"), table.union(table.where("k = 7")), table.withColumn("t", F.when(F.col("k") == 7, "x").otherwise(F.col("t"))), table.fillna({"t": ""}), table.withColumnRenamed("t", "h").select("k", "g", F.col("h").alias("a"))):
        assert digest(other) != whole
    parts = digests.table_digest(table, by=("g",)).collect()
    assert sum(p["n"] for p in parts) == 400 and len({p["digest"] for p in parts}) == 3
    assert digests.table_digest(table.limit(0)).first()["n"] == 0
    twice = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert digest(twice.limit(1)) != digest(twice.where("x = 'a'"))


def test_changes_of_manifests(spark):
    make = lambda rows: digests.manifest(spark.createDataFrame(rows, "k string, a string, b string"), "k", {"a": "a", "b": "b"})
    old, new = make([("1", "x", "y"), ("2", "x", None), ("3", "x", "y")]), make([("2", "z", "y"), ("3", "x", "y"), ("4", "x", "y")])
    assert sorted(map(tuple, digests.changes(new, old).collect()), key=str) == sorted([("1", "removed", None, None, None), ("2", "changed", "a", "x", "z"), ("2", "changed", "b", None, "y"), ("4", "added", None, None, None)], key=str)
    assert [digests.universe(new, b) for b in (None, old, new.repartition(3))] == ["unknown", "changed", "unchanged"]


def test_the_sign_test_is_exact(spark):
    pairs = [(w, n) for w in range(9) for n in range(9)] + [(700, 610), (3000, 3000), (0, 1500)]

    def plain(w, n):
        m = w + n
        return sum(math.comb(m, i) for i in range(m + 1) if abs(2 * i - m) >= abs(w - n)) / 2**m

    found = spark.createDataFrame(pairs, "w long, n long").select("w", "n", variants.sign_p(F.col("w"), F.col("n")).alias("p")).collect()
    assert all(r.p == pytest.approx(plain(r.w, r.n), rel=1e-8, abs=1e-300) for r in found)


def test_variants_are_tallied_over_one_set_of_candidates(spark):
    candidates = spark.createDataFrame([(q, c, i, r + 1) for q in (1, 2, 3) for c, ids in (("a", [10, 11, 12]), ("b", [12, 13, 10])) for r, i in enumerate(ids)], "query int, channel string, id int, rank int")
    few = spark.createDataFrame([("one", "a", 1.0, 1), ("two", "b", 1.0, 1), ("both", "a", 1.0, 3), ("both", "b", 1.0, 3)], "variant string, channel string, weight double, most int")
    results = variants.fused(candidates, few, final=2)
    assert {(r.variant, r.id, r["rank"]) for r in results.where("query = 1").collect()} == {("one", 10, 1), ("two", 12, 1), ("both", 10, 1), ("both", 12, 2)}
    relevant = spark.createDataFrame([(1, 12), (2, 12), (2, 12), (3, 10), (4, 10)], "query int, id int")
    rows = {r.variant: (r.n, r.hits, r.wins, r.losses) for r in variants.compared(variants.hits(results, relevant, few), "one").collect()}
    assert rows == {"one": (4, 1, 0, 0), "two": (4, 2, 2, 1), "both": (4, 3, 2, 0)}
    sizes = spark.createDataFrame([(10, 100), (11, 100), (12, 5)], "id int, size int")
    fits = {(r.variant, r.most, r.budget): (r.n, r.hits) for r in variants.within_budget(results, sizes, relevant, [1, 2], [50, 500], header=10).collect()}
    assert fits["both", 2, 50] == (3, 2) and fits["both", 1, 50] == (3, 0) and fits["both", 2, 500] == (3, 3)


WORD = re.compile(r"[^\W_]+(?:[’'\-][^\W_]+)*")


def described(text):
    out = []
    for b in (x.strip() for x in re.split(r"\n\s*\n", text or "")):
        if b:
            key = re.sub(r"\s+", " ", re.sub(r"[`*_>#|~]", " ", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", b))).strip().lower()
            lines = [x.strip() for x in b.splitlines() if x.strip()]
            out.append((b, key, set(WORD.findall(key)), b.startswith(("#", "- ", "* ", "+ ", "> ")) or sum(x.startswith("|") for x in lines) >= 2))
    return out


def plain_supplement(full, more, most=80):
    have = described(full)
    keys, cover, out, seen = {k for _, k, _, _ in have}, set().union(*[w for _, _, w, _ in have]), [], set()
    for b, k, w, own in described(more):
        if k and k not in keys and k not in seen and w and len(w & cover) / len(w) < (0.98 if own else 0.90) and (len(w) >= 4 or own):
            out.append(b)
            seen.add(k)
    return out[:most]


def plain_without_repeats(text):
    keys, cover, out = set(), set(), []
    for b, k, w, own in described(text):
        if (k and k in keys) or (not own and len(w) >= 2 and w <= cover):
            continue
        out.append(b)
        keys.add(k)
        cover |= w
    return out


def test_blocks_as_by_an_ordered_fold(spark):
    draw = random.Random(6)

    def block():
        words = [f"w{draw.randint(0, 25)}" for _ in range(draw.choice([0, 1, 2, 3, 5, 9, 12, 60]))]
        return draw.choice(["", "", "# ", "- ", "> ", "| a |\n| ", "**", "[link](x) "]) + " ".join(words) + draw.choice(["", "", "!", " _it's_ ", "\n", " well-known"])

    text = lambda: draw.choice(["\n\n", "\n \n", "\n\n\n"]).join(block() for _ in range(draw.randint(0, 30)))
    rows = [(k, text(), text()) for k in range(200)] + [(900, None, "a b c d e"), (901, "a b c d e", None), (902, "", "\n\n"), (903, "x", "\n\n".join(f"n{k} m{k} o{k} p{k}" for k in range(100)))]
    table = spark.createDataFrame(rows, "k int, full string, more string")
    found = table.select("k", blocks.supplemental(F.col("full"), F.col("more")).alias("s"), blocks.without_repeats(F.col("more")).alias("r")).collect()
    for r, (_, full, more) in zip(sorted(found, key=lambda r: r.k), rows, strict=True):
        assert r.s == plain_supplement(full, more), (full, more)
        assert r.r == plain_without_repeats(more), more
    long = "\n\n".join(f"word{k} and some more of it {k % 50}" for k in range(20_000))
    assert len(spark.createDataFrame([(long,)], "t string").select(blocks.without_repeats(F.col("t")).alias("r")).first().r) == 20_000


def test_blocks_take_time_that_follows_the_length_of_a_text(spark):
    # 15,000 distinct blocks; compared one by one with what is known, either way takes minutes.
    full = "\n\n".join(f"Left{k} right{k} up{k} down{k}" for k in range(15_000))
    more = "\n\n".join(f"left{k} right{k} up{k} other{k}" for k in range(15_000))
    pair = spark.createDataFrame([(full, more)], "full string, more string")
    began = time.monotonic()
    found = pair.select(blocks.supplemental(F.col("full"), F.col("more"), 20_000).alias("s"), F.size(blocks.without_repeats(F.concat("more", F.lit("\n\n"), "more"))).alias("n")).first()
    assert found.s == more.split("\n\n") and found.n == 15_000
    assert time.monotonic() - began < 10


def test_blocks_of_a_known_key_are_left_out_by_the_first_of_any_kind(spark):
    # A heading behind dropped prose with its key, marks alone again, a no-break space, which is no white space, and a letter with a sign of its own.
    text = "# one two\n\none three two\n\ntwo one\n\n# two one\n\n***\n\n***\n\nx\u00a0y\n\nx y z\n\nÜber-maß’s e\u0301a"
    found = spark.createDataFrame([(text,)], "t string").select(blocks.without_repeats(F.col("t")).alias("r")).first().r
    assert found == ["# one two", "one three two", "***", "***", "x\u00a0y", "x y z", "Über-maß’s e\u0301a"]
    one = spark.createDataFrame([(text,)], "t string").coalesce(1)
    assert one.select(blocks.supplemental(F.lit("ONE  two\n\n[two](x) three"), F.col("t")).alias("s")).first().s == []


def test_block_queries_of_one_file_use_all_cores(spark):
    docs = comparisons._supplements(spark, "/root/testdata/sf0.01")
    assert "RoundRobinPartitioning" in docs._jdf.queryExecution().executedPlan().toString()


def test_bm25_by_blocks_is_that_of_plain_counts(spark, monkeypatch):
    for name, size in (("DOC_ROWS", 16), ("QUERY_ROWS", 2), ("_TILE", 40)):
        monkeypatch.setattr(lexical, name, size)
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["the", "The", "é9", *"abcdefgh"], [40, 5, 3, *range(1, 9)], k=draw.randrange(60))) for _ in range(200)] + [None, "", "..."]
    asked = ["the a", "é9 é9 h", "zzz", None, "b c d the", "g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = lexical.bm25(spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"), docs, 7)
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    counts = [Counter(cut(t)) for t in texts]
    mean = sum(c.total() for c in counts) / len(counts)
    want = []
    for i, q in enumerate(asked):
        scored = []
        for k, c in enumerate(counts):
            score = 0.0
            for w, qf in Counter(cut(q)).items():
                df = sum(w in c2 for c2 in counts)
                score += math.log1p((len(texts) - df + 0.5) / (df + 0.5)) * qf * 2.5 * c[w] / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean))
            if score > 0:
                scored.append((-round(score, 9), k))
        want += [(i, k, round(-s, 6), r) for r, (s, k) in enumerate(sorted(scored)[:7], 1)]
    got = [(r.item_id, r.doc_id, round(r.score, 6), r.rank) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    # No word is a key of what is scored.
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_word_vectors_are_counted_where_a_text_is_read(spark):
    texts = ["a b b", "b a b", "", None, "...", "é word Word 7"]
    found = variants.word_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.embedding for r in found.collect()}
    want = {}
    for k, text in enumerate(texts):
        for word, n in sorted(Counter(re.findall(r"\w+", (text or "").lower())).items()):
            digest = hashlib.md5(word.encode()).hexdigest()
            want.setdefault(k, [0.0] * variants.SIZE)[int(digest[:4], 16) % variants.SIZE] += (1 if digest[4] <= "7" else -1) * math.log1p(n)
    assert got.keys() == want.keys() == {0, 1, 5} and got[0] == got[1]
    assert all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_overlap_recall_groups_as_many_rows_in_a_task_at_any_size(spark, monkeypatch):
    exact = [(q, k) for q in range(40) for k in range(q % 7 + 1)] + [(None, 1), (50, None)]
    given = [(q, k) for q in range(0, 45) for k in range(0, 9, 2)] + [(None, 1), (50, None), (60, 1)]
    pairs = lambda rows: spark.createDataFrame(rows, "q long, k long")
    monkeypatch.setattr(evaluation, "TASK_ROWS", 10)
    found = evaluation.overlap_recall(pairs(exact), pairs(given * 2), "q", "k")
    want = {q: (q % 7 // 2 + 1) / (q % 7 + 1) for q in range(40)} | {None: 0.0, 50: 0.0}
    assert {r.q: round(r.recall, 9) for r in found.collect()} == {q: round(x, 9) for q, x in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" in plan
    tasks = int(re.search(r"RepartitionByExpression \[[^\]]*\], (\d+)", plan)[1])
    assert tasks >= (len(exact) + 2 * len(given)) // 10


def odd_texts(folder, queries):
    """Small tables with odd rows in ``folder``, and what DuckDB makes of them by each of the queries."""
    duck = duckdb.connect()
    # w3 and w12 share a place and take each other away; so do they in the last item, which keeps another word.
    duck.execute(f"""COPY (SELECT i - 30 AS doc_id, 'one two three four five six seven w' || i % 9 || ' x' || i % 7 AS text FROM range(60) t(i) UNION ALL SELECT -50, 'w3 w12' UNION ALL SELECT 99, 'W12, w3!' UNION ALL SELECT 98, 'w31'
    UNION ALL SELECT NULL, 'one two' UNION ALL SELECT NULL, 'two w3' UNION ALL SELECT 97, NULL UNION ALL SELECT 96, '...') TO '{folder}/documents.parquet'""")
    duck.execute(f"""COPY (SELECT i - 2 AS item_id, 'three four five six seven w' || i || ' x' || i || ' one two' AS text FROM range(6) t(i) UNION ALL SELECT 1, 'one two three four five six seven w1 x1' UNION ALL SELECT 20, 'w3 w12'
    UNION ALL SELECT 21, 'w12 w3 x1' UNION ALL SELECT 22, 'w31' UNION ALL SELECT NULL, 'one two' UNION ALL SELECT 23, NULL) TO '{folder}/benchmark.parquet'""")
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = {}
    for name in queries:
        answer = duck.execute(comparisons.FAMILY.oracle[name])
        found[name] = [d[0] for d in answer.description], answer.fetchall()
    return found


def test_word_vectors_of_odd_rows_as_by_sql(spark, tmp_path):
    names, want = odd_texts(tmp_path, ["text_vectors_topk"])["text_vectors_topk"]
    got = comparisons.FAMILY.queries["text_vectors_topk"](spark, str(tmp_path)).select(names).collect()
    assert Counter(map(str, map(tuple, got))) == Counter(map(str, want))
    by = {(r[names.index("item_id")], r[names.index("rank")]): (r[names.index("doc_id")], r[names.index("score")]) for r in want}
    # A text without length comes first where it shares a place, and what shares none is left out.
    assert [d for (item, _), (d, score) in sorted(by.items()) if item == 21 and math.isnan(score)] == [-50, 99]
    assert 0 < sum(item == 22 for item, _ in by) < comparisons.MOST


def test_budgets_of_odd_rows_as_by_sql(spark, tmp_path):
    names, want = odd_texts(tmp_path, ["variant_budgets"])["variant_budgets"]
    got = comparisons.FAMILY.queries["variant_budgets"](spark, str(tmp_path)).select(names).collect()
    assert Counter(map(tuple, got)) == Counter(want) and sum(r[names.index("hits")] for r in want) > 0


def test_texts_of_one_key_are_one_text(spark):
    rows = [(1, "a b"), (1, "b c"), (2, "a b b c"), (None, "a"), (3, None)]
    found = variants.nearest_texts(spark.createDataFrame([(-2, "a b"), (-2, "b c")], "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert [(r.item_id, r.doc_id, r.score, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(-2, 1, 1.0, 1), (-2, 2, 1.0, 2)]


def test_scores_of_text_vectors_are_rounded_as_by_sql(spark, monkeypatch):
    # Nine digits that end in a half of the sixth; scaled, some of them are a little less.
    scores = [round((k + 0.5) / 1e6, 9) for k in range(0, 1_000_000, 101)]
    assert sum(x * 1e6 % 1 < 0.5 for x in scores) > 50
    rows = [(1, k, x, k) for k, x in enumerate(scores)]
    monkeypatch.setattr(comparisons, "_alike", lambda s, f: s.createDataFrame(rows, "item_id long, doc_id long, score double, rank int"))
    got = {r.doc_id: r.score for r in comparisons.FAMILY.queries["text_vectors_topk"](spark, "").collect()}
    assert got == {k: duckdb.execute("SELECT round($1::DOUBLE, 6)", [x]).fetchone()[0] for _, k, x, _ in rows}
