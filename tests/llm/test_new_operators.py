"""Prefix trie, tokenizer alignment, archive conversion and small near duplicates, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomtrail.llm import alignment, archives, counted_join, near_dedup, prefix_trie, running_sums
from loomtrail.llm.code import ship
from loomtrail.llm.prefix_trie_queries import rebuilt
from loomtrail.scale import stage, staged_path

# --- alignment ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.default_path(), alignment.default_model())


def brute_alignment(aligner, text):
    """Counts, digest and links of one text, from the tokens of the whole text."""
    nothing = (0, 0, 0, 0, ""), Counter()
    if not text:
        return nothing
    raw = (" " + text).encode()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    spans = []
    for ids, content in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        if b"".join(content[i] for i in ids) != raw:
            return nothing
        ends = np.cumsum([len(content[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends)))
    links = Counter(
        (a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)
    )
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = []
    for low, high in zip([0, *cuts], cuts):
        sides = [[i for i, (_, e) in zip(ids, own) if low < e <= high] for ids, own in zip((a, b), spans)]
        groups.append("|".join(",".join(map(str, s)) for s in sides))
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return (len(a), len(b), len(groups), sum(links.values()), digest), links


LETTERS = " \n\t\rab.,'sÉé1中\xa0\x1c<|>①😀▁"
TEXTS = ["<|endoftext|> a<s>b</s>", "don't ’s", "x" * 500, "The quick brown föx\n\njumps <0x41>", "a▁b", "  ", "\n", "\na", " lead",
         "the end of the end", "The end, of it", None, "", "tie", "tie"]


def test_chunks_align_like_whole_texts(aligner):
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(25))) for _ in range(1500)] + [t or "" for t in TEXTS]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        got = aligner.rows(part)
        for i, text in enumerate(part):
            counts, links = brute_alignment(aligner, text)
            assert tuple(got[n][i] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == counts, text
            s, e = got["offsets"][i : i + 2]
            codes = [divmod(p, aligner.width) for p in got["pairs"][s:e].tolist()]
            assert dict(zip(codes, got["times"][s:e].tolist())) == links, text


def test_forgetting_chunks_changes_nothing(aligner):
    few = alignment.Aligner(alignment.default_path(), alignment.default_model(), remembered=1)
    for text in ("one two three", "two three four", "one▁ two"):
        assert few.rows([text])["groups_sha256"] == aligner.rows([text])["groups_sha256"]


def test_coarse_cuts_are_refined_inside_letters():
    assert alignment.refine([3, 3, 4], [False, True, True], [1, 2, 1]) == [1, 3, 4]
    assert alignment.refine([2, 4], [True, True], [1, 3]) is None


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 3])
def test_alignment(spark, aligner, broadcast_pairs):
    ship(spark)
    rows = [(k % 12 if k else None, t, "n", 1) for k, t in enumerate(TEXTS)] + [(40 + k, "the end", "n", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row int")
    got = alignment.scored(alignment.linked(docs), aligner.width, broadcast_pairs)
    found = [brute_alignment(aligner, t) for _, t, _, _ in rows]
    held = Counter(p for _, links in found for p in links)
    best = {a: max(n for (x, _), n in held.items() if x == a) for a, _ in held}
    want = Counter()
    for (doc_id, *_), (counts, links) in zip(rows, found):
        n_best = sum(t for p, t in links.items() if held[p] == best[p[0]])
        want[(doc_id, *counts, n_best, sum(t * held[p] for p, t in links.items()))] += 1
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want
    assert alignment.align(docs.limit(0)).count() == 0


def test_token_groups_spell_the_text(spark, aligner):
    ship(spark)
    docs = spark.createDataFrame([(1, "Ein Bär, ①😀 läuft.\nSo"), (2, None), (3, "a▁b")], "doc_id long, text string")
    rows = sorted(alignment.token_groups(docs).collect(), key=lambda r: r.place)
    assert {r.doc_id for r in rows} == {1}
    raw = " Ein Bär, ①😀 läuft.\nSo".encode()
    for r in rows:
        for ids, content in ((r.a_ids, aligner.a_bytes), (r.b_ids, aligner.b_bytes)):
            assert b"".join(content[i] for i in ids) == raw[r.start : r.stop]
    assert [r.start for r in rows] == [0, *[r.stop for r in rows][:-1]] and rows[-1].stop == len(raw)


# --- prefix trie -------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: t[:3])
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = [t[2:] for t in own.get(c - c % 20, [])[:h]] + [t[2:] for t in own[c][h:]]
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[n] for n in children[node]) or 1
        saved[node] = sum(saved[n] for n in children[node]) + (len(members[node]) - 1) * words
    ends = {n: ",".join(str(c) for c in m if len(built[c]) == len(n)) for n, m in members.items()}
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(children[n]), leaves[n], saved[n],
         hashlib.sha256(ends[n].encode()).hexdigest())
        for n, m in members.items()
    )


def conversations():
    """Shared beginnings, equal conversations, a very long one, missing values, repeated rows and numbers."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 400, 3), *range(0, 400, 40)]:
        kind = rng.randrange(5)
        n = [2, 7, 9, 12, rng.randrange(1, 14)][kind]
        for t in range(n):
            text = f"hello there {t}" if kind < 4 and t < n - rng.randrange(3) else f"w{rng.randrange(5)} x"
            rows.append((c, t, rng.choice(["user", "user", None, ""]) if kind == 4 else "user", text))
    rows += [(5000, t, "user", f"long {t % 7}") for t in range(1500)]
    rows += [(5001, None, None, None), (5001, None, None, None), (5002, 3, "a", "same"), (5002, 3, "b", "same"), (5003, 1, "q", ""),
             (None, 1, "user", "lost"), (-7, 0, "user", "hello there 0"), (7001, 0, "x", "y")]
    return rows


@pytest.mark.parametrize("hot_children", [100_000, 2])
def test_prefix_trie(spark, hot_children):
    ship(spark)
    rows = conversations()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, n1 string, depth int")
    turns, ids = rebuilt(stage(prefix_trie.ordered_turns(df), "turns"))
    got = prefix_trie.prefix_trie(turns, ids, hot_children).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    ship(spark)
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(*rebuilt(stage(prefix_trie.ordered_turns(df), "turns"))).count() == 0


def test_ids_are_hashed_over_chunks_and_batches(monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rows = [(1, 1, k) for k in range(8)] + [(1, 2, 9)] + [(2, 0, k) for k in range(7)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["n1", "n2", "conv_id"])
               for part in (rows[:5], rows[5:12], rows[12:])]
    chunks = list(prefix_trie._id_chunks(iter(batches)))
    assert max(len(t.split(",")) for b in chunks for t in b.column("ids").to_pylist()) == 3
    got = [tuple(r.values()) for b in prefix_trie._digests(b.select(["n1", "n2", "ids"]) for b in chunks) for r in b.to_pylist()]
    text = {k: ",".join(str(i) for a, b, i in rows if (a, b) == k) for k in [(1, 1), (1, 2), (2, 0)]}
    assert got == [(*k, hashlib.sha256(t.encode()).hexdigest()) for k, t in text.items()]


def test_running_sums_across_parts(spark):
    rows = [(0 if k % 3 else k, k, k % 5) for k in range(600)]
    df = spark.createDataFrame(rows, "key long, at long, v long").repartition(7)
    got = running_sums.running_sums(df, "key", [F.col("at").asc()], {"total": F.col("v")}).collect()
    seen = defaultdict(int)
    want = {}
    for key, at, v in rows:
        seen[key] += v
        want[at] = seen[key]
    assert {r["at"]: r.total for r in got} == want


def test_counted_join(spark):
    rows = stage(spark.createDataFrame([(1 if k < 50 else k, k) for k in range(60)] + [(None, 99)], "k long, v long"), "rows")
    table = rows.where("k <> 55").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for how, n in (("inner", 59), ("left", 61)):
        got = counted_join.counted_join(rows, table, ["k"], "n", how, hot=10).collect()
        assert len(got) == n and all(r.top == (49 if r.k == 1 else r.v) for r in got if r.k not in (55, None))


# --- archives ----------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    ship(spark)
    big, other = "<p>équal\r\n\r\nWARC/1.1\n" + "x" * 1200, "<p>" + "y" * 2000
    rows = [(k, f"http://h/{k}", big) for k in range(30)] + [
        (40, None, None), (41, "", ""), (42, "http://a b/\n", "short"), (43, "http://c", "short"), (44, "u", "z" * 200_000),
        (None, "http://none", other), (50, "http://o", other), (50, "http://o", other), (51, "filedesc://x", "odd"),
        (52, "http://x", "1" * 1000), (53, "http://x", "1" * 1000), (54, "http://x", "2" * 999), (55, "http://x", "2" * 999),
    ]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, offset int, archive string")
    arc = archives.write_arc(pages, staged_path(spark, "arc"), archive_bytes=20_000)
    assert archives.read_arc(spark, arc).count() == len(rows)
    warc = archives.convert(spark, arc, staged_path(spark, "warc"), archive_bytes=20_000)
    records = archives.read_warc(spark, warc)
    got = archives.resolved(records).collect()
    assert all(r.digest_holds for r in got)
    by = defaultdict(list)
    for page_id, _, html in rows:
        by[(html or "").encode()].append(page_id)
    want = []
    for payload, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda i: (i is not None, i), reverse=True):
            again = len(payload) >= 1000 and kept
            kept = True
            want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert records.select("record_id").distinct().count() == len(rows)
    assert archives.resolved(archives.read_warc(spark, archives.convert(
        spark, archives.write_arc(pages.limit(0), staged_path(spark, "arc")), staged_path(spark, "warc")))).count() == 0


def test_header_lines_of_both_versions():
    body = bytes(range(256)) + b"\n\nhttp://not.a.header 1 2 3 4\n"
    one = archives.version_block(1, "a.arc") + b"\nhttp://x/a b 1.2.3.4 20010203040506 image/png %d\n" % len(body) + body + b"\n"
    line = b"http://y/ 1.2.3.4 199902 text/html 404 - - 77 b.arc 4\n"
    two = archives.version_block(2, "b.arc") + b"\n" + line + b"gone\n" + line.replace(b" 4\n", b" 9\n") + b"cut"
    (first,), (second, third) = archives.parse_arc(one), archives.parse_arc(two)
    assert first["values"]["URL"] == "http://x/a b" and first["block"] == body and not first["truncated"]
    assert second["values"]["Result-code"] == "404" and second["block"] == b"gone"
    assert third["truncated"] and third["block"] == b"cut"
    assert archives.iso_date("199902") == "1999-02-01T00:00:00Z"
    row = {"archive": "a", "offset": 5, "url": "http://x", "date": "20010203040506", "content_type": "image/png", "is_http": False,
           "block": body, "truncated": False, "to_archive": None}
    ((headers, block),) = archives.parse_warc(archives._converted(row))
    assert block == body and headers["warc-type"] == "resource" and headers["warc-date"] == "2001-02-03T04:05:06Z"
    assert archives.record_id("a", 5) == headers["warc-record-id"] != archives.record_id("a", 6)
    with pytest.raises(ValueError):
        list(archives.parse_arc(b"filedesc://x 0.0.0.0 1 text/plain 12\n3 0 x\nURL A\n\n"))


def test_documents_that_are_not_text_keep_their_bytes(spark):
    ship(spark)
    body = bytes(range(256)) * 4
    content = archives.version_block(1, "a") + b"\nhttp://x/a.png 1.2.3.4 20010203040506 image/png %d\n" % len(body) + body
    path = staged_path(spark, "raw-arc")
    frame = spark.createDataFrame([(bytearray(content),)], "record binary")
    archives._write(frame, path, "\n")
    warc = archives.convert(spark, path, staged_path(spark, "warc"))
    (row,) = archives.read_warc(spark, warc).collect()
    assert (row.record_type, row.payload_bytes, row.payload_digest) == ("resource", 1024, hashlib.sha1(body).hexdigest())


# --- near duplicates of short texts ------------------------------------------------------------


def test_short_texts_meet_by_likeness_only(spark):
    ship(spark)
    rng = random.Random(2)
    rows = []
    for k in range(4000):
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(1, 30))]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = near_dedup.sketches(docs, 4).select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = own.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").count()
    assert shared == 0


def test_small_sets_that_are_alike_share_a_band():
    rng = np.random.default_rng(4)
    for size in (1, 4, 5, 9, 40, 130):
        missed = 0
        for _ in range(200):
            pool = rng.integers(0, 1 << 63, 2 * size + 2, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * size + 2).astype(np.uint64)
            drop = size // 5
            a, b = np.unique(pool[:size]), np.unique(pool[drop:size])
            keys = [near_dedup.band_keys(s, near_dedup.registers(s)) for s in (a, b)]
            missed += not (keys[0] == keys[1]).any()
        assert missed == 0


# --- pages and the pipeline --------------------------------------------------------------------

PAGES = {
    '<article><p>One <span class="share">x</span> two.</p><p>Three.</p></article>': ["One two.", "Three."],
    '<article><p>One <a class="comment-link">c <a>d</a> e</a> two</p></article>': ["One two"],
    '<div class="layout has-sidebar"><nav>menu</nav><article><p>Body</p></article></div>': ["Body"],
    '<article class="search-result"><p>Body</p></article>': ["Body"],
    '<form id="aspnet"><article>Body</article><button>b</button></form>': ["Body"],
    '<p title="un closed>Body': ["Body"],
    '<article>Real</article><div class="related"><article>Teaser</article></div>': ["Real"],
    '<article>Real<div class=comments><article class="comment">no</article></div></article>': ["Real"],
    "<aside><article>no</article></aside>text": ["text"],
    '<article>a <em class="notice">n</em> b <sup class="ad">1</sup></article><footer>f</footer>': ["a b"],
}


@pytest.mark.parametrize("page", PAGES)
def test_marks_end_where_they_should(page):
    from loomtrail.llm import html_text

    assert [t for t, _ in html_text.page_blocks(page)] == PAGES[page]


def test_broken_pages_take_linear_time():
    import time

    from loomtrail.llm import html_text

    started = time.perf_counter()
    assert html_text.page_blocks("<div>" * 100_000 + "</foo>" * 100_000 + "x") == [("x", True)]
    assert time.perf_counter() - started < 20


def test_pipeline_keeps_a_column_named_findings(spark):
    import corpus_pipeline

    ship(spark)
    docs = spark.createDataFrame([(1, "mail me@example.com", "keep me", 3), (None, "same", "a", 1), (None, "same", "a", 1)],
                                 "doc_id long, text string, findings string, n_chars int")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    rows = corpus_pipeline.pii_stage(spark, kept, "").collect()
    assert sorted(r.findings for r in rows) == ["a", "keep me"] and kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in rows)
