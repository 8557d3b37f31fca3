"""The training-data operators against brute force, and on awkward and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from fixturelake.llm import chunks, common, decontam, html, jaccard, mixing, quality, sharding, suffix, suffix_array, tokens, toxicity
from fixturelake.llm.entries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, n long, h string, label string, spans string, score double"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=3):
    """Texts with copies, near copies, shared passages, repeats, nulls, empty and long ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    passage = prose(rng, 90)
    texts = [*base, None, "", " \n\t ", "x", base[3], base[3], base[7].upper(), passage, passage + " " + base[5], base[8] + "\n" + passage, (base[9] + "\n") * 3, "ab " * 900, prose(rng, 9000)]
    for k in range(10, 40):
        w = base[k].split()
        for _ in range(2):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += ["ünï €uro 漢字 " * 80, "a\x0bb\x0cc d e f g"]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "h", "l", "s", 0.5) for r in rows], DOCS).repartition(3)


def sets(text, width):
    w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(spark, width, percent):
    rows = corpus()
    of = {r[0]: sets(r[1], width) for r in rows}
    parent = {i: i for i in of}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in of:
        for j in of:
            if i < j and of[i] and of[j] and 100 * len(of[i] & of[j]) >= percent * len(of[i] | of[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_classes(frame(spark, rows), width, percent / 100).collect()}
    assert got == {i: (len(s), root(i)) for i, s in of.items()}


def test_jaccard_blocks_of_a_large_region(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "LEAF", 12)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rng = random.Random(1)
    base = prose(rng, 60).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["one", "two", "three"])
        rows.append((i, " ".join(w), "en", "s", 0))
    of = {r[0]: sets(r[1], 4) for r in rows}
    label = {i: i for i in of}
    for _ in of:
        for i in of:
            for j in of:
                if 100 * len(of[i] & of[j]) >= 85 * len(of[i] | of[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id: r.component_id for r in jaccard.near_classes(frame(spark, rows), 4, 0.85).collect()} == label


def test_suffix_array_is_the_sorted_suffixes():
    import numpy as np

    rng = random.Random(2)
    for k in (1, 2, 3, 6):
        for _ in range(60):
            s = [rng.randrange(k) for _ in range(rng.randint(1, 50))]
            got = suffix_array.suffix_array(np.array(s, np.int64), k).tolist()
            assert got == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize(("width", "gram", "hot"), [(40, 8, 10**7), (40, 8, 100)])
def test_suffix_dedup(spark, width, gram, hot):
    rows = corpus(5)
    raws = {r[0]: (r[1] or "").encode() for r in rows}
    seen = Counter(b[i : i + width] for b in raws.values() for i in range(len(b) - width + 1))
    docs = frame(spark, rows)
    keys = {r.key: r.doc_id for r in docs.select("doc_id", suffix._key().alias("key")).collect()}
    got = {keys[r.key]: [(s.a, s.b) for s in r.spans] for r in suffix.cut_spans(docs, width, gram, shard_bytes=5000, hot_bytes=hot).collect()}
    for i, b in raws.items():
        cover = [False] * len(b)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                cover[k : k + width] = [True] * width
        want, at = [], 0
        while at < len(b):
            if cover[at]:
                end = next((e for e in range(at, len(b)) if not cover[e]), len(b))
                want.append((at, end))
                at = end
            at += 1
        assert got.get(i, []) == want


def test_suffix_dedup_digest(spark, tmp_path):
    text = prose(random.Random(8), 120)
    frame(spark, [(1, text, "", "", 0), (1, text, "", "", 0), (2, text[:399], "", "", 0), (3, None, "", "", 0)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in QUERIES["op2_suffix_array_dedup"](spark, str(tmp_path)).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(1, len(text), none), (1, len(text), none), (2, 0, hashlib.sha256(text[:399].encode()).hexdigest()), (3, 0, none)]


@pytest.mark.parametrize(("width", "gram"), [(400, 64), (40, 8), (41, 8), (40, 39), (40, 40)])
def test_segments_of_a_shared_window_agree_beside_their_anchor(width, gram):
    rng = random.Random(width + gram)
    passage = prose(rng, width // 4 + 30).encode()
    raws = [b"".join((prose(rng, rng.randint(0, 150)).encode(), passage[rng.randrange(20) :], prose(rng, rng.randint(0, 150)).encode())) for _ in range(8)]
    met, pairs = defaultdict(list), 0
    for raw in raws:
        for anchor, start, end, double, bands in zip(*suffix.segments(raw, width, gram), strict=True):
            for at in range(start, end - width + 1):
                met[raw[at : at + width]].append((anchor, double, bands))
    for same in met.values():
        for anchor, double, bands in same[1:]:
            pairs += 1
            assert anchor == same[0][0]
            assert double or same[0][1] or ((bands == same[0][2]) & (bands != 0)).any()
    assert pairs > 100


@pytest.mark.parametrize(("size", "compared"), [(290, False), (450, True)])
def test_texts_of_a_short_common_passage_are_not_compared(spark, tmp_path, monkeypatch, size, compared):
    rng, written, write = random.Random(size), {}, suffix.Tables.write
    passage = prose(rng, 150)[:size]
    texts = [f"{prose(rng, rng.randint(80, 120))} \u20ac{passage} {prose(rng, rng.randint(80, 120))}" for _ in range(40)]
    raws = [x.encode() for x in texts]
    seen_at = Counter(b[i : i + 400] for b in raws for i in range(len(b) - 399))

    def seen(self, df, name):
        out = write(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(suffix.Tables, "write", seen)
    frame(spark, [(i, x, "", "", 0) for i, x in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    want = {}
    for i, b in enumerate(raws):
        gone = {at + k for at in range(len(b) - 399) if seen_at[b[at : at + 400]] > 1 for k in range(400)}
        want[i] = (len(b), len(gone), int(bool(gone)), hashlib.sha256(bytes(x for at, x in enumerate(b) if at not in gone)).hexdigest())
    assert got == want and all((v[1] > 0) == compared for v in got.values())
    assert (written["pieces"] > 0) == compared


def test_chunks(spark):
    rows = corpus(6)
    docs = frame(spark, rows)
    where = defaultdict(list)
    raws = {r[0]: (r[1] or "").encode() for r in rows}
    ends = {i: chunks.cuts(__import__("numpy").frombuffer(b, "uint8")) for i, b in raws.items()}
    for i, b in raws.items():
        for s, e in zip([0, *ends[i]], ends[i], strict=False):
            assert 0 < e - s <= chunks.MAX
            where[b[s:e]].append((i, s))
    want = {}
    for i, b in raws.items():
        spans = []
        for s, e in zip([0, *ends[i]], ends[i], strict=False):
            if where[b[s:e]][0] != (i, s) and min(where[b[s:e]]) != (i, s):
                if spans and spans[-1][1] == s:
                    spans[-1][1] = e
                else:
                    spans.append([s, e])
        want[i] = [tuple(x) for x in spans if x[1] - x[0] >= chunks.MIN_RUN]
    got = {r.doc_id: [(s.s, s.e) for s in r.spans] for r in chunks.repeated_spans(docs).collect()}
    assert {i: s for i, s in want.items() if s} == {i: s for i, s in got.items() if s}
    kept = {r.doc_id: r.text for r in chunks.deduplicated(docs).collect()}
    assert kept[0] == rows[0][1] and kept[60] is None
    cut = {r.doc_id: r.text for r in suffix.deduplicated(docs, 40).collect()}
    assert cut[60] is None and cut[63] == "x"


@pytest.mark.parametrize("seed", range(4))
def test_chunks_find_each_other_after_insertions(seed):
    import numpy as np

    rng = random.Random(seed)
    passage = prose(rng, 60)
    cut = []
    for lead in ("", "some words before ", prose(rng, 40) + " "):
        b = (lead + passage + " the end").encode()
        e = chunks.cuts(np.frombuffer(b, np.uint8))
        cut.append({b[x:y] for x, y in zip([0, *e], e, strict=False)})
    shared = set.intersection(*cut)
    assert sum(map(len, shared)) >= chunks.MIN_RUN


def test_quality_statistics(spark):
    rows = corpus(7)
    got = {r.doc_id: r for r in quality.quality_verdicts(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        w = WORDS.findall(text or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_separates_planted_junk(spark):
    rng = random.Random(4)
    good = [" ".join(f"{prose(rng, 12).capitalize()}." for _ in range(6)) for _ in range(120)]
    bad = [" ".join(f"{w}{rng.choice(['***', '%%%', '###'])}" for w in prose(rng, 90).split()) for _ in range(20)] + [" | ".join(prose(rng, 80).split()) for _ in range(20)]
    rows = [(i, t, "", "", 0) for i, t in enumerate(good + bad)]
    kept = {r.doc_id for r in quality.quality_verdicts(frame(spark, rows)).where("kept").collect()}
    assert kept == set(range(len(good)))
    clean = {r.doc_id for r in quality.quality_verdicts(frame(spark, rows[: len(good)])).where("kept").collect()}
    assert clean == set(range(len(good)))


def test_token_counts_and_resynchronisation(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(8), (900, "<|endoftext|> it's 12á İx <|startoftext|>", "", "", 0), (901, "x" * 700, "", "", 0), (902, None, "", "", 0)]
    lib = Tokenizer.from_file(tokens.vocabulary_path())
    want = {r[0]: len(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    for chunk, overlap in ((10**6, 100), (300, 20), (97, 3)):
        got = {r.doc_id: r.n_tokens for r in tokens.token_counts(frame(spark, rows), chunk=chunk, overlap=overlap).collect()}
        assert got == want


def test_token_counts_of_vocabularies_with_white_space(spark):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path("byte_bpe_50k.json")
    assert tokens.cut_at_white_space(tokens.vocabulary_path()) and not tokens.cut_at_white_space(path)
    rows = corpus(8)
    lib = Tokenizer.from_file(path)
    want = {r[0]: len(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(frame(spark, rows), path, chunk=300).collect()} == want


def test_sql_of_base_columns_and_shard_law(spark, tmp_path):
    import duckdb

    from fixturelake.llm.entries import ORACLES

    frame(spark, [*corpus(7), (None, "no id", None, None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, str(tmp_path))
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, found.fetchall())), name


def test_shards(spark):
    rows = [*corpus(9), (3, "again", "", "", 0), (None, "null id", "", "", 0), (5, "same", "", "", 0), (5, "same", "", "", 0)]
    docs = frame(spark, rows)
    got = sharding.shard_slots(docs, 8, bucket_rows=10).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(len(by[k]) for k in range(8)) <= 1
    again = sharding.shard_slots(docs, 8, bucket_rows=10).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None]
    assert order != sorted(order)
    full = sharding.assign(docs, 8).collect()
    assert Counter((r.doc_id, r.text) for r in full) == Counter((r[0], r[1]) for r in rows)
    assert len({(r.shard, r.slot) for r in full}) == len(rows)


def test_shards_are_written(spark, tmp_path):
    docs = frame(spark, corpus(9))
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(rng.choice(["zzz", "yyy", "xxx"]) for _ in range(60)), "", "", 0) for i in range(300)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    targets = {"high": 0.5, "low": 0.5}
    got = mixing.document_rates(frame(spark, rows), labels, "CASE WHEN quality = 1 THEN 'high' ELSE 'low' END", targets).collect()
    total = sum(r.tokens for r in got)
    for d, share in targets.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) / total - share) < 0.01
    assert all(r.rate >= 0 for r in got)
    right = [(r.p_high > 0.5) == bool(r.doc_id % 3) for r in got if r.doc_id % 2]
    assert sum(right) / len(right) > 0.95
    kept = mixing.mixed(frame(spark, rows), labels, "CASE WHEN quality = 1 THEN 'high' ELSE 'low' END", targets)
    assert kept.select("doc_id").distinct().count() == 300 and kept.count() > 330
    assert kept.columns == frame(spark, rows).columns


def test_decontamination(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (8, 20, 33, 60)] + ["too short", None, ""]
    edit = items[3].split()
    edit[30] = "other"
    texts = {1: "lead " + items[0].upper() + " tail", 2: prose(rng, 50) + " " + items[2] + ".", 3: prose(rng, 80), 4: " ".join(edit), 5: None, 6: "", 7: items[1], 8: items[1], 9: " ".join(items[3].split()[:20]) + prose(rng, 60), 10: "too short"}
    docs = frame(spark, [(i, t, "", "", 0) for i, t in texts.items()])
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, length int")
    want = {(1, 0), (2, 2), (4, 3), (7, 1), (8, 1)}
    for small in (10**6, 0):
        common.FEW_ROWS, before = small, common.FEW_ROWS
        found = {r.key: r.item_id for r in decontam.leaks(docs, bench).collect()}
        common.FEW_ROWS = before
        assert {(i, found[hashlib.md5((t or "").encode()).hexdigest()]) for i, t in texts.items() if hashlib.md5((t or "").encode()).hexdigest() in found} == want
    left = decontam.clean_documents(docs, bench)
    assert {r.doc_id for r in left.collect()} == set(texts) - {i for i, _ in want} and left.columns == docs.columns


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randint(20, 200)).split()
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["snarkoid", "grumblix", "vexulard"]) + rng.choice(["", "en", "o"]))
        rows.append((i, " ".join(w), "", "", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, "such a SN4RKO1D and grуmblix he is", "", "", 0), (2001, None, "", "", 0), (2002, "", "", "", 0)]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, toxicity.learn(docs, marks)).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert 200 < len(held) < 400 and all(got[i].predicted == int(i % 6 == 0) for i in held)
    assert got[2000].predicted == 1 and got[2001].predicted == got[2002].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


PAGES = {
    "http://a.org/1": "<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; tail</h1><p>One <b>bo</b>ld<br>line<p>Two &eacute;&#8217;s</p><aside>See also</aside></article><div id=comments><p>Nice post</p></div><footer>&copy; a</footer>",
    "http://b.org/1": "<body><div class=menu><ul><li><a href=1>x</a><li><a href=2>y</a></ul></div><div class=wrap><div class=post><p>First   words\n here.</p><ul><li>item one<li>item two</ul><form>Mail <input> <button>Go</button></form></div><div class='sidebar'>Links</div></div></body>",
    "http://c.org/1": "plain text only",
    None: None,
}


def test_html_main_text(spark):
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(PAGES.items())], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_texts(pages).collect()}
    assert got[0][0] == "Head & tail One bold line Two é’s"
    assert got[1][0] == "First words here. item one item two"
    assert got[3] == ("", 0)
    many = [(i, f"http://a.org/{i}", f"<body><div>Same top</div><div><p>Text number {i} of the page.</p></div><div>Same end</div></body>", "x") for i in range(8)]
    texts = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(many, pages.schema)).collect()}
    assert texts == {i: f"Text number {i} of the page." for i in range(8)}


AWKWARD = [(1, "a b c d e f g " * 30, "en", "s", 1), (1, "a b c d e f g " * 30, "en", "s", 1), (1, "other text with the same id", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None), (4, "", "", "", 0), (5, "word " * 20000, "en", "s", 0)]


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_and_empty_tables(spark, tmp_path, empty):
    docs = frame(spark, AWKWARD)
    pages = spark.createDataFrame([(1, None, None, "h"), (None, "x", "<p>a</p>", "h"), (1, None, None, "h")], "page_id long, url string, html string, host string")
    bench = spark.createDataFrame([(None, None, 1), (2, "a b c d e f g a b c", 1)], "item_id long, text string, key int")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (None, [0.25] * 64), (2, None), (3, [1.0]), (4, [None] * 64)], "vec_id long, embedding array<float>")
    for name, df in {"documents": docs, "pages": pages, "benchmark": bench, "labels": labels, "embeddings": vectors}.items():
        (df.limit(0) if empty else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    one_each = {"op1", "op2", "op4", "op6", "op7", "op8", "op9", "op10", "op13"}
    rows = {name: f(spark, str(tmp_path)).collect() for name, f in QUERIES.items()}
    found = {name.split("_")[0]: x for name, x in rows.items()}
    for name in one_each:
        assert len(found[name]) == (0 if empty else len(AWKWARD)), name
    assert len(found["op3"]) == len(found["op12"]) == (0 if empty else 3)
    assert found["op11"] == []  # no word of five letters occurs three times
    if empty:
        assert not found["op5"] and not rows["quality_base_columns"] and not rows["shard_counts"]
        return
    of = lambda name, *cols: Counter(tuple(r[c] for c in cols) for r in found[name])
    assert of("op1", "doc_id", "n_shingles", "component_id") == Counter({(1, 7, 1): 2, (1, 3, 1): 1, (None, 1, None): 1, (None, 0, None): 1, (4, 0, 4): 1, (5, 1, 5): 1})
    none = hashlib.sha256(b"").hexdigest()
    kept = [hashlib.sha256(t.encode()).hexdigest() for t in ("other text with the same id", "no id")]
    assert of("op2", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter({(1, 420, 420, 1, none): 2, (1, 27, 0, 0, kept[0]): 1, (None, 5, 0, 0, kept[1]): 1, (None, 0, 0, 0, none): 1, (4, 0, 0, 0, none): 1, (5, 100_000, 100_000, 1, none): 1})
    assert of("op12", "vec_id", "distance", "inertia") == Counter({(1, 0, 0): 2, (None, 0, 0): 1})
    assert sorted(r.n_tokens for r in found["op13"])[:2] == [0, 0] and {r.ids_sha256 for r in found["op13"] if not r.n_tokens} == {none}
    assert {(r.page_id, r.text, r.n_chars) for r in found["op3"]} == {(1, "", 0), (None, "a", 1)}
    assert of("op5", "doc_id", "item_id", "similarity") == Counter({(1, 2, 1.0): 2})
    assert len({r.score for r in found["op4"]}) == 1 and {r.predicted for r in found["op4"]} == {0}
    assert of("op7", "doc_id", "tokens") == Counter({(1, 210): 2, (1, 6): 1, (None, 2): 1, (None, 0): 1, (4, 0): 1, (5, 20_000): 1})
    assert of("op8", "doc_id", "size") == Counter({(1, 421): 2, (1, 28): 1, (None, 6): 1, (None, 1): 1, (4, 1): 1, (5, 100_001): 1})
    assert of("op9", "doc_id", "n_bytes", "n_spans")[(1, 27, 0)] == 1 and sorted(r.n_removed for r in found["op9"] if r.n_bytes == 420)[1] == 420
    assert of("op10", "doc_id", "n_words", "n_repeat_words", "base_failed", "kept") == Counter({(1, 210, 210, True, False): 2, (1, 6, 0, True, False): 1, (None, 2, 0, True, False): 1, (None, 0, 0, True, False): 1, (4, 0, 0, True, False): 1, (5, 20_000, 20_000, True, False): 1})


def test_pipeline_of_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    frame(spark, AWKWARD).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark, [*corpus(11), (None, "no id at all", None, None, None), (3, corpus(11)[3][1], "en", "s0", 0)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, corpus(11)[20][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in out)
    of = {i: sets(t, 5) for i, t, *_ in corpus(11)}
    for i, s in of.items():
        twin = any(j < i and s and of[j] and len(s & of[j]) >= 0.8 * len(s | of[j]) for j in of)
        if twin:
            assert i not in ids
    assert 20 not in ids and None in ids and 0 in ids
    assert {c for r in out for c in r.asDict()} == {*docs.columns, "shard", "slot"}
