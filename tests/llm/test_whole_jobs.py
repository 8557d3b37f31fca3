"""Inputs on which an operator once did less than its whole job."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from fixturelake.llm import chunks, common, decontam, graph, html, jaccard, mixing, quality, sharding, suffix, toxicity


def union_find(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    return {x: top(x) for x in root}


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    ids = [rng.getrandbits(62) for _ in range(1200)]
    edges = list(zip(ids[:999], ids[1:1000], strict=True)) + [(ids[i], ids[i + j]) for i in range(1000, 1190) for j in (1, 2, 3)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == union_find(edges)
    assert sorted(map(len, _groups(got).values())) == [193, 1000]


def _groups(labels):
    groups = defaultdict(list)
    for node, label in labels.items():
        groups[label].append(node)
    return groups


def test_a_chain_of_linked_texts_is_one_component(spark):
    rng = random.Random(5)
    chain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(10_000)]
    # each text shares 91 of its 97 shingles with the next one, and 85 with the one after
    rows = [(k, " ".join(chain[6 * k : 6 * k + 100])) for k in range(1000)] + [(5000, " ".join(chain[9000:9100]))]
    got = {r.doc_id: r.component_id for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.85).collect()}
    assert got == {k: 0 for k in range(1000)} | {5000: 5000}


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_regions_divide_recursively(spark, monkeypatch, seed):
    """A cloud of near copies, many of them unlinked, against brute force, with small regions and few pivots."""
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    divided = []
    divide = jaccard.divide
    monkeypatch.setattr(jaccard, "divide", lambda rows, *more: divided.append(rows.count()) or divide(rows, *more))
    rng = random.Random(seed)
    bases = [words(rng, 120).split() for _ in range(2)]
    texts = []
    for k in range(150):
        w = list(bases[k % 2])
        for _ in range(rng.choice([0, 1, 2, 3, 8, 20])):
            w[rng.randrange(120)] = words(rng, 1)
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(117)} for t in texts]
    edges = [(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = {i: i for i in range(150)} | union_find(edges)
    got = {r.doc_id: r.component_id for r in jaccard.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 0.85).collect()}
    assert divided and got == want


def test_near_classes_tell_equal_ids_apart(spark):
    rng = random.Random(3)
    one, two = words(rng, 40), words(rng, 40)
    rows = [(7, one), (7, two), (7, two), (3, two), (None, one), (None, None), (9, " ")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.key == r.first_key) for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.85).collect())
    assert got == [(False, 3, 37, 3, True), (False, 7, 37, 3, False), (False, 7, 37, 3, False), (False, 7, 37, 7, True), (False, 9, 0, 9, True), (True, 0, 0, 0, True), (True, 0, 37, 7, False)]


def test_mixing_keeps_every_document_of_overlapping_domains(spark):
    rng = random.Random(2)
    rows = []
    for i in range(2000):
        p = 1 / (1 + math.exp(-rng.gauss(-2.5 if i % 25 < 3 else 2.5, 1.5)))
        rows.append((f"k{i}", 1, 100, [p, 1 - p]))
    soft = spark.createDataFrame(rows, "key string, copies long, tokens long, p array<double>").coalesce(1).cache()
    got = mixing.rated(soft, {"high": 0.92, "low": 0.08}, grow=True).collect()
    assert len(got) == 2000 and min(r.rate for r in got) >= 1
    share = sum(r.rate * r.p[0] for r in got) / sum(r.rate for r in got)
    assert abs(share - 0.92) < 0.005


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_chunks_catch_passages_of_51_words():
    found = []
    for seed in range(1000):
        rng = random.Random(seed)
        passage = f" {words(rng, 51)} "
        cut = []
        for _ in range(2):
            raw = (words(rng, rng.randint(20, 60)) + passage + words(rng, 40)).encode()
            ends = chunks.cuts(np.frombuffer(raw, np.uint8))
            cut.append([raw[s:e] for s, e in zip([0, *ends], ends, strict=False)])
        runs = [0]
        for c in cut[1]:
            runs = [*runs[:-1], runs[-1] + len(c)] if c in set(cut[0]) else [*runs, 0]
        found.append(sum(r for r in runs if r >= chunks.MIN_RUN) / len(passage))
    assert min(found) > 0 and sum(found) / len(found) > 0.75


def test_chunks_remove_copies_of_short_texts(spark):
    docs = spark.createDataFrame([(1, "a short text"), (2, "a short text"), (3, "a short one"), (4, ""), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in chunks.deduplicated(docs).collect()} == {1: "a short text", 2: "", 3: "a short one", 4: "", 5: None}


def test_toxicity_keeps_exceptions_of_a_large_lexicon(spark):
    rng = random.Random(4)
    stems = [f"{a}{b}{c}z" for a in "bcdfghkmnp" for b in "bcdfghkmnp" for c in "bcdfgh"]
    clean = [f"{a}{b}{c}" for a in "aeiouwxy" for b in "aeiouwxy" for c in "aeiouwxy"]
    rows = [(" ".join(rng.sample(stems, len(stems))), 1) for _ in range(16)] + [(" ".join(rng.sample(clean, len(clean))), 0) for _ in range(80)]
    rows += [(" ".join(f"safe {s}" for s in stems), 0)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert sum(w > 0 for w in lexicon.values()) == 600
    assert {k for k, w in lexicon.items() if w < 0} >= {f" safe {s} " for s in stems}


def test_html_keeps_articles_that_are_copied(spark):
    page = "<html><body><{0}><h1>Heading of the page</h1><p>The only paragraph</p></{0}><div class=x>{1}</div></body></html>"
    rows = [(k, None, page.format("article", "")) for k in range(8)]
    rows += [(k + 10, "http://b.org/x", page.format("div", "")) for k in range(8)]
    rows += [(k + 20, f"http://c.org/{k}", page.format("article", f"seen {k}")) for k in range(6)]
    got = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 22 and {r.text for r in got} == {"Heading of the page The only paragraph"}


def test_toxicity_learns_from_repeated_rows_once(spark):
    rows = [(3, "one text")] * 500 + [(k, f"text {k}") for k in range(4, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3, 60)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels)
    assert got.count() == got.distinct().count() > 20
    once, counted = [(x / 7, int(x > 3), 1) for x in range(8)] * 5 + [(0.1, 1, 1)] * 3, [(x / 7, int(x > 3), 5) for x in range(8)] + [(0.1, 1, 3)]
    assert np.allclose(toxicity.fit_curve(once), toxicity.fit_curve(counted))


def test_shards_spread_a_row_of_many_copies(spark, monkeypatch):
    docs = spark.createDataFrame([(None, None)] * 3000 + [(k, f"t{k}") for k in range(6000)], "doc_id long, text string")
    sizes = []
    shuffle = sharding.F.shuffle

    def watched(col, seed):
        sizes.append(col)
        return shuffle(sharding.F.when(sharding.F.size(col) < 1300, sharding.F.col(col)), seed)

    monkeypatch.setattr(sharding.F, "shuffle", watched)
    got = sharding.shard_slots(docs, 8, bucket_rows=600).collect()
    assert sizes and len(got) == 9000
    assert Counter(r.doc_id for r in got) == Counter({None: 3000} | {k: 1 for k in range(6000)})
    assert len({(r.shard, r.slot) for r in got}) == 9000 and {r.slot for r in got} == set(range(1125))


def test_shards_depend_on_rows_and_seed_only(spark):
    docs = spark.createDataFrame([(k, f"text {k % 50}") for k in range(500)] + [(None, None)] * 40, "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    seen = []
    for n, adaptive, parts in (("4", "true", 3), ("16", "true", 1), ("5", "false", 7)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        seen.append(sorted(map(str, sharding.shard_slots(docs.repartition(parts), 8, bucket_rows=60).collect())))
    for k, v in before.items():
        spark.conf.set(k, v)
    assert seen[0] == seen[1] == seen[2]
    assert seen[0] != sorted(map(str, sharding.shard_slots(docs, 8, seed=1, bucket_rows=60).collect()))


def test_shards_take_rows_of_very_many_copies(spark, monkeypatch):
    from fixturelake.llm import common

    rows = [(1, "same", k) for k in range(200)] + [(k, f"t{k}", k) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = sharding.assign(docs, 4).collect()
    monkeypatch.setattr(common.numbered, "__defaults__", (20,))
    hot = sharding.assign(docs, 4).collect()
    for out in (got, hot):
        assert Counter((r.doc_id, r.text) for r in out) == Counter((a, b) for a, b, _ in rows)
        assert len({(r.shard, r.slot) for r in out}) == 250 and {r.shard for r in out} == set(range(4))


def test_chunks_tell_equal_ids_apart_and_drop_copies_of_rows(spark):
    rng = random.Random(6)
    passage, other = words(rng, 60), words(rng, 60)
    rows = [(1, passage), (1, other), (1, other), (2, words(rng, 20) + " " + passage), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in chunks.deduplicated(docs).collect())
    texts = [t for _, t in kept]
    assert sorted(texts)[:3] == ["", "", ""] and passage in texts and texts.count(other) == 1
    assert len([t for i, t in kept if i == 2][0]) < len(rows[3][1]) - 100


def test_chunks_that_are_frequent_meet_without_a_shuffle(spark):
    rng = random.Random(7)
    common = words(rng, 80)
    docs = spark.createDataFrame([(k, f"{words(rng, 15)} {common} {words(rng, 15)}") for k in range(120)], "doc_id long, text string")
    few, every = (sorted(map(str, chunks.repeated_spans(docs, sample=s).collect())) for s in (0.0, 1.0))
    assert few == every and len(few) == 120


def weighted_windows(text, items, width=5):
    """item: best weighted Jaccard similarity of any window of the item's length, by looking at all of them."""
    grams = lambda t: [tuple(w[i : i + width]) for w in [t.lower().split()] for i in range(len(w) - width + 1)]
    df = Counter(g for t in items for g in set(grams(t)))
    weight = lambda g: round(1000 * math.log(1 + len(items) / df[g])) if g in df else round(1000 * math.log(1 + len(items)))
    own, best = grams(text), {}
    for k, item in enumerate(items):
        want = set(grams(item))
        n = len(grams(item))
        for s in range(max(1, len(own) - n + 1)):
            have = set(own[s : s + n])
            both = sum(map(weight, have & want))
            best[k] = max(best.get(k, 0), both / sum(map(weight, have | want)))
    return best


def test_decontamination_looks_at_all_windows(spark):
    """Items that are swapped, inserted into, shortened and edited, against all windows of all texts."""
    rng = random.Random(8)
    items = [words(rng, n) for n in (12, 30, 30, 60, 90, 140)]
    items.append(items[1][: len(items[1]) // 2] + words(rng, 15))
    texts = []
    for item in items:
        w = item.split()
        h = len(w) // 2
        texts += [" ".join(w), " ".join(w[h:] + w[:h]), " ".join([*w[:h], words(rng, 1), *w[h:]]), " ".join(w[:h] + w[h + 1 :]), " ".join(w[h // 2 :]), " ".join([*w[: h - 1], words(rng, 2), *w[h:]]), " ".join([*w[:h], *w[h - 2 :]]), item + " " + item]
    docs = [f"{words(rng, rng.randint(0, 40))} {t} {words(rng, rng.randint(0, 40))}".strip() for t in texts] + [words(rng, 80) for _ in range(10)]
    want = {(i, k): v for i, t in enumerate(docs) for k, v in weighted_windows(t, items).items() if v >= 0.8}
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    key = {hashlib.md5(t.encode()).hexdigest(): i for i, t in enumerate(docs)}
    got = {(key[r.key], r.item_id): r.similarity for r in decontam.leaks(frame, bench).collect()}
    assert len(want) > 25 and set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and {p for p, v in want.items() if v >= 0.9} <= set(got)
    assert all(abs(want[p] - v) < 1e-6 or v >= 0.8 for p, v in got.items())


def test_every_pair_within_the_radius_meets(spark):
    rng = random.Random(9)
    rows = [(k, rng.getrandbits(64) - 2**63) for k in range(40)]
    turned = []
    for k, fp in rows:
        for n in (0, 5, decontam.RADIUS - 1, decontam.RADIUS, decontam.RADIUS + 1):
            x = fp
            for b in rng.sample(range(64), n):
                x ^= (1 << b) if b < 63 else -(2**63)
            turned.append((1000 * n + k, x))
    windows = spark.createDataFrame([(a, 7, b) for a, b in turned], "w long, length int, fp long")
    items = spark.createDataFrame([(a, 7, b) for a, b in rows], "item long, length int, item_fp long")
    got = {(r.w, r["item"]) for r in decontam.near_pairs(windows, items).collect()}
    want = {(w, i) for w, x in turned for i, y in rows if ((x ^ y) & (2**64 - 1)).bit_count() <= decontam.RADIUS}
    assert got == want and len(want) >= 160


PAGES = [
    ("plain text &amp; nothing else", "plain text & nothing else"),
    ("<p title=it's>hello there second", "hello there second"),
    ('<p class="a>b">one</p><p data-x=\'y">\'>two', "one two"),
    ('<a href="broken>link</a><p>He said "so" and left.</p>', 'He said "so" and left.'),
    ("<article><h1>T</h1><p class=share-price>up</p><p class=legal-analysis>law</p><div class=comments-intro>on</div><div class=share-buttons>tweet</div><section id=comments>me too</section></article>", "T up law on"),
    ("<body><header>Site</header>Bare text of a page.<footer>end</footer></body>", "Bare text of a page."),
    ("<nav><a href=1>Home</a></nav><ul><li><a href=2>x</a></ul>", ""),
    ("<body><div class=post><header class=entry-header><h1>Head</h1></header><p>Body a &lt; b</p></div><div class=cookieNotice>We use</div></body>", "Head Body a < b"),
    ("<div class='post has-sidebar'><p>One two</p></div><aside>side</aside>", "One two"),
    ("", ""),
]


def test_html_of_odd_pages(spark):
    rows = [(k, f"http://h{k}.org/", h) for k, (h, _) in enumerate(PAGES)] + [(99, "http://x.org/", None)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: t for k, (_, t) in enumerate(PAGES)} | {99: ""}


def test_html_of_repeated_rows(spark):
    page = "<body><div class=top>{0}</div><article><p>Text {1}</p></article></body>"
    rows = [(k, f"http://a.org/{k}", page.format("Same", k)) for k in range(6)]
    got = sorted((r.page_id, r.text) for r in html.main_texts(spark.createDataFrame(rows * 3, "page_id long, url string, html string")).collect())
    assert got == sorted([(k, f"Text {k}") for k in range(6)] * 3)


def test_toxicity_exceptions_of_long_words(spark):
    long = "grumblix" + "a" * 30
    rows = [(" ".join(words(rng, 20).split() + ["grumblix"]), 1) for rng in map(random.Random, range(20))] + [(f"{words(rng, 20)} harmless {long}", 0) for rng in map(random.Random, range(50, 60))]
    rows += [(words(rng, 20), 0) for rng in map(random.Random, range(100, 300))]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert any(k.endswith(f" {toxicity.fold(long).strip()} ") and v < 0 for k, v in lexicon.items())


def test_quality_posteriors_are_those_of_plain_counts(spark):
    """Expectation-maximisation over counted patterns equals the same over single votes."""
    rng = random.Random(10)
    votes = [tuple(rng.choice([-1, 0, 1, 1]) for _ in range(3)) for _ in range(60)]
    counted = quality.estimate(sorted(Counter(votes).items()), 3)
    single = quality.estimate([(v, 1) for v in sorted(votes)], 3)
    assert all(abs(counted[v] - single[v]) < 1e-9 for v in set(votes))


def test_session_settings_come_back(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    jaccard.near_classes(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string"), 4, 0.85)
    assert before == {k: spark.conf.get(k) for k in before}


def test_a_shared_folder_is_asked_for_off_local_mode():
    from fixturelake import cluster

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cluster.shared_dir(Session)


def test_html_of_mirrors_and_shared_standfirsts(spark):
    """Equal text of an article on five pages and more is no template."""
    mirror = "<html><body><div class=wrap><h1>Heading of all mirrors</h1><div><p>The only paragraph of the article, in a plain container</p></div></div><div class=x>seen {}</div></body></html>"
    story = "<html><body><div class=story><div class=lead>A standfirst that all pages share</div><div class=rest>{}</div></div></body></html>"
    rows = [(k, "http://m.org/", mirror.format(k)) for k in range(6)]
    rows += [(10 + k, "http://s.org/", story.format(" ".join(f"word{k}of{j}" for j in range(30)))) for k in range(6)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Heading of all mirrors The only paragraph of the article, in a plain container" in got[k] for k in range(6))
    assert all(got[10 + k] == "A standfirst that all pages share " + " ".join(f"word{k}of{j}" for j in range(30)) for k in range(6))


@pytest.mark.parametrize("page", ["<div><p>x " * 50_000, "<b>x</i> " * 50_000, "<i><div>" + "<b>x</i> " * 50_000, "<table><tr><td>x " * 20_000, "<div class='some name'>" * 50_000 + "x"])
def test_html_of_deep_and_unbalanced_pages(page):
    began = time.process_time()
    found = html.blocks(page)
    text = html.main_text(found, set(), None, set())
    assert " ".join(b[2] for b in found).split() == ["x"] * page.count("x") and set(text.split()) == {"x"}
    assert time.process_time() - began < 6


def test_html_cut_inside_a_word():
    assert [b[2] for b in html.blocks("<p>un<span class=ad>x <b>y</b></span>believable <i>text</i></p>") if b[2]] == ["unbelievable text"]


def _both_ways(spark, rows, schema):
    for some in (rows, rows[::-1]):
        yield spark.createDataFrame(some, schema).coalesce(1)


def test_labels_that_disagree(spark):
    """Which of an id's label rows comes first does not matter."""
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(40)], "doc_id long, text string")
    rows = [(k, k % 2, j) for k in range(40) for j in ((0, 1) if k % 3 == 0 else (0,))]
    learnt = [sorted(map(tuple, toxicity.training_rows(docs, labels).collect())) for labels in _both_ways(spark, rows, "doc_id long, quality int, toxic int")]
    assert learnt[0] == learnt[1] and ("text number 12", 1) in learnt[0] and len({t for t, _ in learnt[0]}) == len(learnt[0])
    rates = [sorted((r.doc_id, round(r.rate, 9)) for r in mixing.document_rates(docs, labels).collect()) for labels in _both_ways(spark, rows, "doc_id long, quality int, toxic int")]
    assert rates[0] == rates[1]


@pytest.mark.parametrize("many", [1, 10_000])
def test_rows_that_differ_in_extra_columns_keep_their_numbers(spark, many):
    rows = [(k % 3, f"extra {k}") for k in range(60)]
    got = []
    for df in _both_ways(spark, rows, "k int, extra string"):
        numbered = common.numbered(df, ["k"], "nth", many).collect()
        assert sorted((r.k, r.nth) for r in numbered) == sorted((k, n) for k in range(3) for n in range(1, 21))
        got.append(sorted(map(tuple, numbered)))
    assert got[0] == got[1]


def covered_bytes(raws, width):
    """For each text, which bytes stand in a window that starts elsewhere too, by counting all windows."""
    seen = Counter(b[i : i + width] for b in raws for i in range(len(b) - width + 1))
    out = []
    for b in raws:
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                cover[i : i + width] = b"\1" * width
        out.append(bytes(cover))
    return out


@pytest.mark.parametrize("hot", [2_000, 10**9])
def test_suffixes_of_one_anchor_in_very_many_segments(spark, hot):
    """A passage shorter than a window stands among other words in each text; some of the surroundings are equal, some repeat."""
    rng = random.Random(6)
    passage, width = words(rng, 8), 100
    ends = [words(rng, 9) for _ in range(40)]
    texts = [f"{words(rng, 6)} {rng.choice(ends)[k % 30 :]} {passage} {rng.choice(ends)} {passage} {words(rng, 4)}" for k in range(120)]
    texts += ["a" * 5_000, "ab" * 3_000 + passage, (ends[0] + " ") * 50, "a" * 150 + ends[1], passage, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.key: r.doc_id for r in docs.select("doc_id", suffix._key().alias("key")).collect()}
    got = {ids[r.key]: r.spans for r in suffix.cut_spans(docs, width, 16, shard_bytes=4_000, hot_bytes=hot).collect()}
    for k, (text, want) in enumerate(zip(texts, covered_bytes([t.encode() for t in texts], width), strict=True)):
        cover = bytearray(len(text.encode()))
        for s in got.get(k, ()):
            cover[s.a : s.b] = b"\1" * (s.b - s.a)
        assert cover == want, k


def test_own_repeats_are_marked_and_each_window_stays_once():
    rng = random.Random(4)
    for _ in range(200):
        pattern = bytes(rng.choices(b"abcd", k=rng.randint(1, 30)))
        raw = bytes(rng.choices(b"ab", k=rng.randint(0, 40))) + pattern * rng.randint(2, 20) + bytes(rng.choices(b"ab", k=rng.randint(40, 60))) + pattern * rng.randint(0, 5)
        width = rng.choice((5, 20, 40))
        covered, kept = suffix.own_repeats(np.frombuffer(raw, np.uint8), width)
        cover = bytearray(len(raw))
        for a, b in covered:
            cover[a:b] = b"\1" * (b - a)
        assert cover == covered_bytes([raw], width)[0]
        left = [raw[i : i + width] for a, b in kept for i in range(a, b - width + 1)]
        assert len(left) == len(set(left)) and set(left) == {raw[i : i + width] for i in range(len(raw) - width + 1)}


def test_one_text_repeats_a_passage_a_million_words_long(spark):
    rng = random.Random(12)
    item = words(rng, 40)
    long = f"{words(rng, 30)} {(item + ' ') * 25_000}{words(rng, 30)}"
    docs = spark.createDataFrame([(1, long), (2, words(rng, 60)), (3, f"{words(rng, 20)} {item}")], "doc_id long, text string")
    found = {r.key: (r.item_id, r.similarity, r.start_word) for r in decontam.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert found == {hashlib.md5(long.encode()).hexdigest(): (5, 1.0, 30), **{k: v for k, v in found.items() if v == (5, 1.0, 20)}} and len(found) == 2
    cut = {r.doc_id: r.text for r in chunks.deduplicated(docs).collect()}
    assert len(cut[1]) < 2_000 and len(cut[2]) == len(docs.where("doc_id = 2").first().text)
    spans = {r.key: [(s.a, s.b) for s in r.spans] for r in suffix.cut_spans(docs).collect()}
    at, size = long.index(item), len(item) + 1
    assert any(a <= at and b >= at + 25_000 * size - 1 for v in spans.values() for a, b in v)


def test_digests_among_the_frequent():
    rng = np.random.Generator(np.random.PCG64(3))
    d = rng.integers(0, 6, (400, 2))  # first halves that agree, too
    often = np.unique(rng.integers(0, 6, (12, 2)), axis=0)
    assert chunks.among(d, often).tolist() == [x in {tuple(o) for o in often.tolist()} for x in map(tuple, d.tolist())]
    assert not chunks.among(d, often[:0]).any()
