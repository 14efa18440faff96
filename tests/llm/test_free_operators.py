"""Near duplicates, licenses, pages, subwords and the pipeline, against brute force."""

import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from loomtrail.llm import html_text, licenses, near_dedup, subwords
from loomtrail.llm.code import ship
from loomtrail.llm.components import connected
from loomtrail.scale import stage

CLASHING = "doc_id long, text string, node string, kept string, digest int, k1 int, h int"


def as_docs(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, "x", "x", 1, 1, 1) for r in rows], CLASHING)


def near_rows(seed=3):
    """A large group of copies with few or many edits, small groups, short texts and edge cases."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    for _ in range(40):
        own = [word() for _ in range(rng.randrange(1, 60))]
        texts.append(" ".join(own))
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [None, "", "  ", "one two", "One  TWO", "long " * 30_000, texts[0], texts[0], texts[5].upper()]
    rng.shuffle(texts)
    return [(k * 7 % 1009, t) for k, t in enumerate(texts)]


def brute_components(rows, size):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    name = {d: d for d in sets}

    def root(d):
        while name[d] != d:
            d = name[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                name[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("small_bucket", [32, 2])
def test_near_duplicates(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small_bucket)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = near_rows()
    got = near_dedup.near_duplicates(as_docs(spark, rows), size=4).collect()
    want = brute_components(rows, 4)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_little(spark):
    docs = as_docs(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, None)])
    rows = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert rows == {(None, 4, False), (4, 4, True), (2, 2, True)} or rows == {(None, 4, True), (4, 4, True), (2, 2, True)}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        common, own = int(3000 * share), int(3000 * (1 - share) / 2)
        pool = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(pool[: common + own]), np.unique(np.r_[pool[:common], pool[common + own :]])
        x, y = near_dedup.registers(a), near_dedup.registers(b)
        n = np.array([len(a)]), np.array([len(b)])
        estimate = ((x == y).sum() - near_dedup.chance_collisions(*n)[0]) / len(x)
        assert abs(estimate - share) < 0.2


def test_components_of_a_chain(spark):
    links = stage(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long"), "chain")
    assert {r.node: r.component for r in connected(links).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_components_of_a_shuffled_chain(spark):
    ids = list(range(3000))
    random.Random(7).shuffle(ids)
    links = stage(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), "chain")
    assert {r.node: r.component for r in connected(links).collect()} == dict.fromkeys(ids, 0)


def test_licenses(spark):
    rows = [
        (1, "Text. Licensed under CC BY-NC 4.0. cc-by; ALL RIGHTS, reserved"), (2, None), (3, ""),
        (4, "under the GNU General Public License version 3"), (4, "under the GNU General Public License version 3"),
        (None, "x " * 40_000 + "all rights reserved"), (5, "Licensed under the new Apache License, Version 2.0"), (6, "cc cc by by"),
        (7, "all of the rights are reserved"), (8, "Straße cK by Key"),
    ]
    got = licenses.scan(as_docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        w = words.findall((t or "").translate(lower))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = by[d]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "cc-by-nc-4.0" in by[1].labels and "apache-2.0" in by[5].labels and by[7].labels == "" and by[2].score == 0
    assert licenses.scan(as_docs(spark, rows).limit(0)).count() == 0


def page(body, k):
    menu = "<div><a>Start</a> <a>News</a> <a>Shop</a> <a>About us</a> <a>Contact</a></div>"
    return f"<html><head><title>t</title></head><body>{menu}<div><p>{body}</p></div><div>Copyright of this site since long ago</div></body></html>"


def test_pages(spark):
    ship(spark)
    article = (
        "<nav><li>Menu</nav><article><h1>A &amp; b</h1><p>One\n <b>two<br>three<p>Four&nbsp;five<div class='ad-slot'>Buy</div>"
        "<section id=comments><p>hi</p></section></article><footer>f</footer><script>var x='<p>no</p>';</script>"
    )
    rows = [(k, f"http://h.org/{k}", page(f"Story {k} tells of things {k * 31} and more {k * 17}.", k)) for k in range(8)]
    rows += [(8, "http://h.org/8", article), (8, "http://h.org/8", article), (9, None, None), (None, "x", ""), (11, "u", "plain <p>text"),
             (12, "http://o.org/", "<p>cut <a href="), (13, "http://o.org/", "<article>" + "<p>long text</p>" * 20_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    for k in range(8):
        assert by[k] == f"Story {k} tells of things {k * 31} and more {k * 17}."
    assert by[8] == "A & b\n\nOne two three\n\nFour five"
    assert by[9] == by[None] == "" and by[11] == "plain\n\ntext" and by[12] == "cut" and by[13].count("long text") == 20_000
    assert html_text.main_text(pages.limit(0)).count() == 0


def texts_of(spark, rows):
    ship(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.main_text(pages).collect()}


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def test_repeats_are_counted_over_a_large_host(spark):
    """260,000 open tokens, and a notice on few of the pages."""
    rng = random.Random(9)
    notice = "Our office in town stays closed on all of the public holidays of this year and the next one too thanks"
    bodies = [prose(rng, 1300) for _ in range(200)]
    rows = [(k, f"http://big.org/{k}", f"<div>{b}</div>" + f"<div>{notice}</div>" * (k in (3, 90, 177))) for k, b in enumerate(bodies)]
    assert texts_of(spark, rows) == dict(enumerate(bodies))


def test_equal_notices_beside_articles(spark):
    """Pages that differ in their articles only count each; equal pages count once."""
    notice = "<div>This site is run by the friends of the old town hall</div>"
    rows = [(k, f"http://n.org/{k}", f"<article><p>Story {k}</p></article>{notice}") for k in range(30)]
    rows += [(100 + k, f"http://same.org/{k}", f"<article><p>Story</p></article>{notice}") for k in range(30)]
    got = texts_of(spark, rows)
    assert all(got[k] == f"Story {k}" for k in range(30))
    assert all(got[100 + k].endswith("town hall") for k in range(30))


def test_phrases_within_sentences_stay(spark):
    rng = random.Random(2)
    menu = "".join(f"<li>{w}</li>" for w in ("Start", "News", "Local sports", "Shop", "Help"))
    notice = prose(rng, 25)
    bodies = [f"{prose(rng, 30)} at the end of the {prose(rng, 9)} on the other side of the river {prose(rng, 30)}" for _ in range(40)]
    rows = [(k, f"http://p.org/{k}", f"<ul>{menu}</ul><p>{b} {notice}</p><p>{b[::-1]}</p>") for k, b in enumerate(bodies)]
    assert texts_of(spark, rows) == {k: f"{b}\n\n{b[::-1]}" for k, b in enumerate(bodies)}


def test_block_runs_cover_what_returns():
    for lengths in ([3, 1, 3], [1] * 7, [2, 9, 1], [4, 1], [1, 1, 1, 1, 1]):
        menu = [" ".join(f"m{i}x{k}" for k in range(n)) for i, n in enumerate(lengths)]
        streams = [[f"a{k}", *menu, f"b{k}"] for k in range(2)]
        often = np.intersect1d(*(html_text.passages(s)[0] for s in streams))
        assert [html_text.unique_runs(s, often) for s in streams] == [[f"a{k}", *[""] * len(menu), f"b{k}"] for k in range(2)]


def test_repeats_against_brute_force():
    rng = random.Random(5)
    for _ in range(50):
        pages = sorted(rng.randrange(5) for _ in range(60))
        tokens = [rng.randrange(3) for _ in pages]
        long, least = rng.randrange(1, 5), rng.randrange(2, 4)
        want = [False] * 60
        grams = {}
        for i in range(61 - long):
            if pages[i] == pages[i + long - 1]:
                grams.setdefault(tuple(tokens[i : i + long]), []).append(i)
        for places in grams.values():
            if len({pages[i] for i in places}) >= least:
                for i in places:
                    want[i : i + long] = [True] * long
        assert html_text.repeated(np.array(tokens), np.array(pages), long, least).tolist() == want


def test_subwords(spark):
    ship(spark)
    path = subwords.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello world", "", " a  b\n\nc ", "é中😀 don't 12", "x" * 50, "tab\there", "unknown unknowable unknown"]
    plain = subwords.Encoder(path, 0, 0.0, 1)
    for t in texts:
        assert np.frombuffer(plain.encode(1, t), "<u4").tolist() == library.encode(t)
    rows = [(k, t) for k, t in enumerate([*texts, None, "letter ▁ itself▁", "word " * 20_000])] + [(None, texts[0])] * 2
    encoded = subwords.encode_documents(as_docs(spark, rows), seed=5, dropout=0.5)
    back = subwords.decode_documents(encoded).select("doc_id", "text", "ids").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in back)) == sorted(((d is None, d or 0, t or "") for d, t in rows))
    assert len({r.ids for r in back if r.doc_id is None}) == 1
    many = {subwords.Encoder(path, s, 0.5, 1).encode(1, "unknowable") for s in range(30)}
    assert len(many) > 5
    assert subwords.encode_documents(as_docs(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        subwords.Encoder(path, 0, 1.0, 1)


def brute_skips(pieces, chunk, key, below):
    """Candidates of an occurrence drawn one after the other."""
    skips = ()
    while True:
        ids, drawn = pieces.segment(chunk, skips)
        start = skips[-1] + 1 if skips else 0
        hit = next((k for k in range(start, len(drawn)) if subwords._mixed(key ^ drawn[k]) >> 32 < below), None)
        if hit is None:
            return ids
        skips += (hit,)


def test_every_occurrence_draws_its_own_skips():
    path = subwords.default_model()
    word, n = "unknowable", 20_000
    encoder = subwords.Encoder(path, 3, 0.1)
    found = encoder._span([" " + word] * n, subwords._mixed_all(np.arange(n, dtype=np.uint64)))
    keys = [subwords._mixed(k) for k in range(n)]
    pieces = encoder.pieces
    assert all(found[k] == np.array(brute_skips(pieces, " " + word, keys[k], encoder.below), "<u4").tobytes() for k in range(500))
    plain, drawn = pieces.segment(" " + word)
    assert len(set(found)) > 20
    # Other merges may lead to the same pieces, so the candidates are counted, not the ids.
    kept = [sum(all(subwords._mixed(k ^ d) >> 32 >= encoder.below for d in drawn[:m]) for k in keys) / n for m in range(1, 9)]
    assert all(abs(share - 0.9**m) < 0.02 for m, share in enumerate(kept, 1))
    assert sum(f == np.array(plain, "<u4").tobytes() for f in found) / n > 0.9 ** len(drawn) - 0.02
    text = " ".join([word] * n)
    assert encoder.encode(1, text) != encoder.encode(2, text)
    whole = encoder.encode(1, text)
    assert subwords.Encoder(path, 3, 0.1, 1).encode(1, text) == whole
    assert encoder.pieces.decode(np.frombuffer(whole, "<u4").tolist()) == text


def test_pipeline_stages(spark):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("row", F.lit(1))
    before = docs
    for k, (_, run) in enumerate(corpus_pipeline.STAGES):
        after = stage(run(spark, before, "/root/testdata/sf0.001"), "pipeline-test")
        if k < 3:
            assert after.columns == docs.columns
        before, previous = after, before
        if k == 1:
            want = brute_components([(r.doc_id, r.text) for r in previous.collect()], 5)
            assert {r.doc_id for r in after.collect()} == {d for d, (n, c) in want.items() if d == c}
    assert before.agg(F.count_distinct("doc_id")).first()[0] == previous.count()
    nothing = docs.limit(0)
    for _, run in corpus_pipeline.STAGES:
        nothing = stage(run(spark, nothing, "/root/testdata/sf0.001"), "pipeline-test")
    assert nothing.count() == 0


def test_archives_are_packed_fast(spark, tmp_path):
    from loomtrail.llm import archives

    text = F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(k % 7))) for k in range(12)])
    records = spark.range(2000).coalesce(1).select(text.cast("binary").alias("record"))
    fast, usual = str(tmp_path / "fast"), str(tmp_path / "usual")
    archives._write(records, fast, "\n")
    records.select(F.col("record").cast("string")).write.option("compression", "gzip").text(usual)
    sizes = [sum(p.stat().st_size for p in (tmp_path / n).glob("part-*.gz")) for n in ("fast", "usual")]
    assert sizes[0] > sizes[1] > 0
    assert sorted(spark.read.text(fast).collect()) == sorted(spark.read.text(usual).collect())


def test_chunks_merged_together_are_cut_as_each_alone():
    rng = random.Random(12)
    pieces = subwords.Pieces(subwords.default_model())
    chunks = [(" " if rng.random() < 0.7 else "") + "".join(rng.choice("etaoinsré—7☃") for _ in range(rng.randrange(1, 70))) for _ in range(900)]
    chunks += [" word", "word", "\n", ""] * 12
    skips = [tuple(sorted(rng.sample(range(6), rng.randrange(4)))) for _ in chunks]
    found = pieces.segment_all(chunks, skips)
    for chunk, own, (ids, drawn) in zip(chunks, skips, found):
        one, every = pieces.segment(chunk, own)
        assert np.frombuffer(ids, "<u4").tolist() == one
        assert np.frombuffer(drawn, "<u8").tolist() == every[own[-1] + 1 if own else 0 :]


def test_a_chunk_is_merged_twice_at_most_however_many_skips_it_has(monkeypatch):
    encoder = subwords.Encoder(subwords.default_model(), 3, 0.3)
    rng = random.Random(5)
    chunk = " " + "".join(rng.choice("etaoinsr") for _ in range(2000))
    key = np.array([7], np.uint64)
    calls = []
    segment = encoder.pieces.segment
    monkeypatch.setattr(encoder.pieces, "segment", lambda *a: calls.append(1) or segment(*a))
    found = encoder._span([chunk], key)
    assert len(calls) == 2
    monkeypatch.undo()
    assert found == [np.array(brute_skips(encoder.pieces, chunk, 7, encoder.below), "<u4").tobytes()]
