import random

import pytest

from askgrid.operators import dedup, metrics, sizing


def greedy(rows, t=0.95):
    """Plain walk: {(group, ord): first kept partner or None}."""
    kept, out = {}, {}
    for g, o, text in sorted(rows, key=lambda r: (r[0], r[1])):
        s = set(text.lower().split())
        partner = next((k for k, ks in kept.get(g, []) if len(s | ks) and len(s & ks) / len(s | ks) > t), None)
        out[g, o] = partner
        if partner is None:
            kept.setdefault(g, []).append((o, s))
    return out


def words(*ranges):
    return " ".join(f"w{i}" for r in ranges for i in r)


def sample(seed=5, n=260):
    rnd, rows = random.Random(seed), []
    base = [words(range(100 * b, 100 * b + rnd.choice((15, 22, 60, 120)))) for b in range(6)]
    for i in range(n):
        ws = rnd.choice(base).split()
        for _ in range(rnd.choice((0, 0, 1, 2, 3, 6))):
            ws[rnd.randrange(len(ws))] = f"n{rnd.randrange(40)}"
        if rnd.random() < 0.1:
            ws = [w.upper() for w in ws]
        rnd.shuffle(ws)
        rows.append((rnd.choice("ab"), i, " ".join(ws) if rnd.random() > 0.03 else "  "))
    return rows


def chain():
    return [
        (1, 0, words(range(60))), (1, 1, words(range(1, 60)) + " x1"), (1, 2, words(range(2, 60)) + " x1 x2"),
        (2, 0, words(range(19)) + " a"), (2, 1, words(range(19))),        # 19 / 20 stays
        (4, 0, words(range(20)) + " a"), (4, 1, words(range(20))),        # 20 / 21 goes
        (3, 0, ""), (3, 1, "  "), (3, 2, "Aa bb"), (3, 3, "bb aA aa"),
    ]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(g, o, o if isinstance(g, str) else g * 100 + o, t) for g, o, t in rows],
                               "g string, ord long, item_id long, text string")
    return dedup.greedy_dedup(df.select("g", "ord", "item_id"), df.select("item_id", "text"), ["g"], "ord", **kw), df


def test_chain_ties_and_empty_texts(spark):
    rows = [(str(g), o, t) for g, o, t in chain()]
    df = spark.createDataFrame([(g, o, int(g) * 100 + o, t) for g, o, t in rows], "g string, ord long, item_id long, text string")
    got = dedup.greedy_dedup(df.select("g", "ord", "item_id"), df.select("item_id", "text"), ["g"], "ord")
    want = {k: v is None for k, v in greedy(rows).items()}
    assert {(r.g, r.ord): r.kept for r in got.collect()} == want
    assert want["1", 2] and not want["1", 1] and want["2", 1] and not want["4", 1] and want["3", 1]


@pytest.mark.parametrize("few,threshold,walk,pairs", [
    (64, 0.95, 256, 9), (64, 0.95, 0, 100_000), (2, 0.95, 0, 5), (3, 0.9, 0, 40), (16, 0.8, 130, 1)])
def test_equals_plain_walk(spark, monkeypatch, few, threshold, walk, pairs):
    """Small groups as arrays, large ones by blocks; pairs in one task, by component, and in rounds."""
    monkeypatch.setattr(dedup, "FEW_ROWS", few)
    monkeypatch.setattr(dedup, "WALK_ROWS", walk)
    monkeypatch.setattr(dedup, "WALK_PAIRS", pairs)
    rows = sample()
    got, _ = run(spark, rows, threshold=threshold)
    want = {k: v is None for k, v in greedy(rows, threshold).items()}
    assert {(r.g, r.ord): r.kept for r in got.collect()} == want


def templates(rnd, n_templates, copies):
    """Filled-in templates: alike in 100 words of 120, yet not duplicates, but for a few."""
    rows = []
    for i in range(n_templates * copies):
        t = i % n_templates
        filled = [f"f{rnd.randrange(400)}" for _ in range(20)]
        if rows and rnd.random() < 0.1:  # a copy with another word
            filled = rows[rnd.randrange(len(rows)) // n_templates * n_templates + t if i > n_templates * 2 else 0][2].split()[100:-1] + [f"n{i}"]
        rows.append(("all", i, " ".join([f"t{t}w{k}" for k in range(100)] + filled)))
    return rows


def test_templates_are_split_by_their_rare_words(spark, monkeypatch):
    """Blocks that only hold words of a template do not shrink by comparing; few rounds must do."""
    monkeypatch.setattr(dedup, "FEW_ROWS", 8)
    rounds, compare = [], dedup._compare
    monkeypatch.setattr(dedup, "_compare", lambda *a: rounds.append(1) or compare(*a))
    rows = templates(random.Random(3), 3, 300)
    got, df = run(spark, rows)
    plain = greedy(rows)
    assert {r.ord for r in got.filter("kept").collect()} == {o for (_, o), p in plain.items() if p is None}
    assert len(rounds) <= 10 and any(p is not None for p in plain.values())
    rounds.clear()
    pairs = dedup.duplicate_pairs(df.select("g", "ord", "item_id"), df.select("item_id", "text"), ["g"], "ord")
    assert {(r.g, r.dup_item): r.kept_item for r in pairs.collect()} == {k: p for k, p in plain.items() if p is not None}


def test_null_groups_and_groups_of_mixed_size(spark, monkeypatch):
    monkeypatch.setattr(dedup, "WALK_ROWS", 20)
    base = sample(4, 120)
    rows = [("big", o, t) for _, o, t in base] + [(None, 1000 + o, t) for _, o, t in base[:12]] + [("s", 2000 + o, t) for _, o, t in base[:9]]
    df = spark.createDataFrame([(g, o, o, t) for g, o, t in rows], "g string, ord long, item_id long, text string")
    got = dedup.greedy_dedup(df.select("g", "ord", "item_id"), df.select("item_id", "text"), ["g"], "ord")
    want = {k: v is None for k, v in greedy([(g or "", o, t) for g, o, t in rows]).items()}
    assert got.columns == ["g", "ord", "item_id", "kept"]
    assert {(r.g or "", r.ord): r.kept for r in got.collect()} == want
    pairs = dedup.duplicate_pairs(df.select("g", "ord", "item_id"), df.select("item_id", "text"), ["g"], "ord").collect()
    assert {(r.g or "", r.dup_item) for r in pairs} == {k for k, kept in want.items() if not kept}


def test_components_of_a_hub_and_a_long_chain(spark):
    from askgrid.operators.components import components

    links = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 4999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(300)}, **{1000 + i: 1000 for i in range(201)}, 4999: 4999, 5000: 4999}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_name_the_first_kept_partner(spark, monkeypatch):
    monkeypatch.setattr(dedup, "WALK_ROWS", 0)
    rows = sample(9, 150)
    _, df = run(spark, rows)
    got = dedup.duplicate_pairs(df.select("g", "ord", "item_id"), df.select("item_id", "text"), ["g"], "ord")
    want = {(g, o): p for (g, o), p in greedy(rows).items() if p is not None}
    assert {(r.g, r.dup_item): r.kept_item for r in got.collect()} == want


def test_a_third_of_all_rows_are_near_copies(spark, monkeypatch):
    """Hot blocks go through the joins for hot keys and one comparison per row."""
    monkeypatch.setattr(sizing, "HOT_KEY_ROWS", 50)
    monkeypatch.setattr(dedup, "WALK_ROWS", 0)
    rows = [("all", i, words(range(200)) + f" copy{i}") for i in range(400)]
    rows += [("all", 400 + i, words(range(1000 * (i + 1), 1000 * (i + 1) + 30))) for i in range(400)]
    rows += [("all", 800 + i, "The same text again " + words(range(30))) for i in range(400)]
    got, _ = run(spark, rows)
    kept = {r.ord for r in got.filter("kept").collect()}
    assert kept == {0, 800} | set(range(400, 800))


def test_same_item_in_many_groups(spark):
    items = spark.createDataFrame([(1, words(range(30))), (2, words(range(30)) + " z")], "item_id long, text string")
    rows = spark.createDataFrame(
        [(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "a", 1), (3, "a", 1), (3, "b", 2)], "q int, ord string, item_id long")
    got = dedup.greedy_dedup(rows, items, ["q"], "ord")
    assert {(r.q, r.ord) for r in got.filter("kept").collect()} == {(1, "a"), (2, "a"), (3, "a")}


def test_words_of_the_items_are_cut_once(spark, monkeypatch):
    """Rounds and the search for partners read the word sets instead of cutting all texts again."""
    cuts, cut = [], dedup.token_set
    monkeypatch.setattr(dedup, "token_set", lambda *a: cuts.append(1) or cut(*a))
    monkeypatch.setattr(dedup, "WALK_ROWS", 0)
    rows = [r for r in sample(11, 40) if r[0] == "a"]
    df = spark.createDataFrame([(g, o, o, t) for g, o, t in rows], "g string, ord long, item_id long, text string")
    got = dedup.duplicate_pairs(df.select("g", "ord", "item_id"), df.select("item_id", "text"), ["g"], "ord")
    want = {(g, o): p for (g, o), p in greedy(rows).items() if p is not None}
    assert {(r.g, r.dup_item): r.kept_item for r in got.collect()} == want
    assert len(cuts) == 1


def jobs_of(spark, name, call):
    """The result of a call and the Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return call(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def clusters(n_clusters, copies):
    """Near copies of some texts, each with one word exchanged, dealt in turn."""
    return [("all", i, " ".join([f"c{i % n_clusters}w{k}" for k in range(60) if k != i // n_clusters % 60] + [f"n{i}"]))
            for i in range(n_clusters * copies)]


@pytest.mark.parametrize("rows,words,pairs", [(4096, 4_000_000, 100_000), (4096, 4_000_000, 3), (30, 4_000_000, 100_000), (4096, 900, 5), (0, 0, 1)])
def test_components_walked_whole_or_thinned_out(spark, monkeypatch, rows, words, pairs):
    """All components in tasks, the small ones only, or none: same rows kept, same partners."""
    monkeypatch.setattr(dedup, "COMPONENT_ROWS", rows)
    monkeypatch.setattr(dedup, "COMPONENT_WORDS", words)
    monkeypatch.setattr(dedup, "WALK_PAIRS", pairs)
    monkeypatch.setattr(dedup, "WALK_ROWS", 0)
    data = sample(21, 160) + [("c" + g, 1000 + o, t) for g, o, t in clusters(2, 40)]
    got, df = run(spark, data)
    plain = greedy(data)
    assert {(r.g, r.ord): r.kept for r in got.collect()} == {k: v is None for k, v in plain.items()}
    found = dedup.duplicate_pairs(df.select("g", "ord", "item_id"), df.select("item_id", "text"), ["g"], "ord").collect()
    assert {(r.g, r.dup_item): r.kept_item for r in found} == {k: p for k, p in plain.items() if p is not None}
    sets = {(g, o): set(t.lower().split()) for g, o, t in data}
    for r in found:
        a, b = sets[r.g, r.dup_item], sets[r.g, r.kept_item]
        assert abs(r.similarity - len(a & b) / len(a | b)) < 1e-6


def test_counts_of_chains_take_few_jobs(spark, monkeypatch):
    """Chains of near copies and large clusters are settled in one walk, not in rounds of jobs."""
    monkeypatch.setattr(dedup, "WALK_ROWS", 0)
    chains = [("all", 10_000 + i, words(range(i // 3, i // 3 + 40)) + f" q{i}") for i in range(300)]
    df = spark.createDataFrame([(g, o, t) for g, o, t in chains + clusters(3, 150)], "g string, ord long, text string")
    rows, items = df.select("g", "ord", df.ord.alias("item_id")), df.select(df.ord.alias("item_id"), "text")
    got, jobs = jobs_of(spark, "counts", lambda: metrics.dedup_counts(dedup.greedy_dedup(rows, items, ["g"], "ord"), ["g"]).collect())
    plain = greedy(chains + clusters(3, 150))
    assert [(r.g, r.n_before, r.n_after) for r in got] == [("all", 750, sum(p is None for p in plain.values()))]
    assert jobs <= 80


def test_only_texts_of_rivals_are_cut(spark, monkeypatch):
    """No table of all words is written, and only rows that share a block are walked."""
    monkeypatch.setattr(dedup, "WALK_ROWS", 0)
    stored, walked, walk = [], [], getattr(dedup, "_walk_near", None)
    monkeypatch.setattr(dedup, "word_sets", lambda items, store=dedup.word_sets: stored.append(items.count()) or store(items))
    monkeypatch.setattr(dedup, "_walk_near", lambda near, *a: walked.append(near.count()) or walk(near, *a), raising=False)
    alone = [("all", 1000 + i, words(range(1000 * (i + 1), 1000 * (i + 1) + 30))) for i in range(200)]
    copies = [("all", 2000 + i, alone[i][2].upper()) for i in range(50)]
    got, _ = run(spark, alone + copies + clusters(4, 5))
    plain = greedy(alone + copies + clusters(4, 5))
    assert {(r.g, r.ord) for r in got.filter("kept").collect()} == {k for k, p in plain.items() if p is None}
    assert stored == [] and walked == [20]


def test_partners_come_from_the_walk(spark, monkeypatch):
    """Dropped rows meet their first kept partner in the walk: no pairs are joined with words. Similarities
    are rounded as by Spark, half up."""
    calls, compare = [], dedup._compare
    monkeypatch.setattr(dedup, "_compare", lambda *a: calls.append(1) or compare(*a))
    rows = clusters(3, 30) + [("all", 500, words(range(125))), ("all", 501, words(range(125)) + " x y z"), ("all", 502, words(range(125)) + " z Y x")]
    df = spark.createDataFrame([(g, o, t) for g, o, t in rows], "g string, ord long, text string")
    got = dedup.duplicate_pairs(df.select("g", "ord", df.ord.alias("item_id")), df.select(df.ord.alias("item_id"), "text"), ["g"], "ord")
    found = {r.dup_item: (r.kept_item, r.similarity) for r in got.collect()}
    assert {k: p for k, (p, _) in found.items()} == {o: p for (_, o), p in greedy(rows).items() if p is not None}
    assert found[501] == found[502] == (500, 0.976563)
    assert calls == []
