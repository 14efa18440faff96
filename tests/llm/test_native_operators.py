"""Quality rules, pseudonyms, fingerprints and URL lists, on built-in functions only."""

import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtrail.llm import fingerprints as fp
from loomtrail.llm import fingerprints_queries, pii, quality, quality_queries, url_filters
from loomtrail.llm.text_native import once

SENTENCE = "The quick brown fox jumps over the lazy dog and runs away from here today."


def python_free(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def texts(spark):
    prose = "\n".join(f"Line {k} says that {' '.join(f'w{k}x{i}' for i in range(9))}." for k in range(6))
    rows = [
        (1, prose), (1, prose), (2, None), (3, ""), (4, " \n\t "), (5, "one | two | three | four\n" + prose),
        (6, "SHOUTING ALL THE TIME IS BAD STYLE!!\n" * 12), (None, prose), (7, (SENTENCE + " ") * 9),
        (8, "\n".join(["word " * 8 + str(k) + "." for k in range(4000)])), (9, "a b c d e f g h"),
    ]
    return spark.createDataFrame([(d, t, "x", 9, "y") for d, t in rows], "doc_id long, text string, kept string, n_words int, _q_text string")


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)})


def test_quality(texts):
    judged = quality.measure(texts)
    assert python_free(judged)
    rows = judged.collect()
    assert len(rows) == 11
    for r in rows:
        assert r.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.n_repeat_words == brute_repeats(r.text)
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[1] and kept[5] and kept[None] and not any(kept[k] for k in (2, 3, 4, 6, 7, 9))
    assert next(r for r in rows if r.doc_id == 5).n_removed_lines == 1
    clean = quality.clean_documents(texts)
    assert clean.columns == texts.columns
    assert sorted((r.doc_id or 0) for r in clean.collect()) == sorted((r.doc_id or 0) for r in rows if r.kept)
    assert "|" not in clean.where("doc_id = 5").first().text
    assert quality.measure(texts.limit(0)).count() == 0


def test_quality_does_not_depend_on_line_lengths(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ar", "ille", "os", "und", "ete", "im", "ova", "ent", "ick", "ud")]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(9)) + rng.choice([".", "!", "?\"", "."]) for _ in range(400)]
    junk = ["Home | News | About | Contact.", "Please read our privacy policy.", "$$$ ### %%% *** save.", "BUY ALL OF THESE THINGS RIGHT AWAY TODAY."]
    mixed = plain[:200] + junk + plain[200:]
    arabic = ["\u0647\u0644 \u0647\u0630\u0627 \u0646\u0635 \u0639\u0631\u0628\u064a " + f"{k} \u061f" for k in range(9)]
    thai = ["\u0e20\u0e32\u0e29\u0e32 \u0e44\u0e17\u0e22 " + f"a{k} b{k} \u0e14\u0e35" for k in range(9)]
    cases = {
        "clean": plain, "mixed": mixed, "one policy": plain[:200] + junk[1:2], "junk": junk * 30, "arabic": arabic, "thai": thai,
        "late policy": [" ".join(rng.choice(vocabulary) for _ in range(300)) + " privacy policy " + plain[0]],
        "stutter": ["spam eggs " * 400 + "end."], "long": [" ".join(rng.choice(vocabulary) for _ in range(20_000)) + "."],
    }
    texts = [(f"{n}/{k}", c.join(v)) for n, v in cases.items() for k, c in (("one", " "), ("many", "\n"))]
    rows = [(k, n, t) for k, (n, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, name string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    judged = quality.measure(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    out = {r.name: r for r in judged.collect()}
    for n in cases:
        one, many = out[f"{n}/one"], out[f"{n}/many"]
        assert one.kept == many.kept == (n not in ("junk", "stutter")), n
        if n != "junk":
            assert one.words_left == many.words_left, n
    assert out["clean/one"].clean_text == " ".join(plain) and out["clean/many"].clean_text == "\n".join(plain)
    assert out["mixed/one"].words_left == out["clean/one"].n_words
    assert out["late policy/one"].words_left == out["late policy/one"].n_words
    digits = spark.createDataFrame([("A" + "1" * 100_000 + " b.",)], "text string")
    assert digits.select(quality.cleaned(F.col("text")).alias("t")).first().t.endswith(" b.")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(quality_queries.SQL)
    names = sorted(c[0] for c in cursor.description)
    want = sorted(tuple(dict(zip([c[0] for c in cursor.description], r))[n] for n in names) for r in cursor.fetchall())
    got = quality_queries.op7(spark, str(tmp_path))
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == want


PII = {
    "card": "4111 1111 1111 1111", "email": "jo.doe+x7@mail.example.org", "phone": "+44 (020) 555-0199", "ip": "10.0.200.7",
    "date": "31/12/1999", "ssn": "123-45-6789", "iban": "DE89 3704 0044 0532 0130 00",
}


def luhn(text):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", text))]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark):
    body = "; ".join(PII.values())
    decoys = "order 4111111111111112, version 1.2.3, 999.1.1.1, 30/02/2001, 000-12-3456, DE00370400440532013000"
    rows = [(1, body, "a"), (1, body, "a"), (2, None, "b"), (3, "", "c"), (4, decoys, "d"), (None, "x " * 50_000 + PII["ip"], None),
            (5, 'token = "0123456789abcdef0123456789abcdef"', None)]
    docs = spark.createDataFrame([(*r, "f", "p") for r in rows], "doc_id long, text string, body string, findings string, _p_new string")
    out = pii.pseudonymize(docs, "k")
    assert python_free(out) and out.columns == ["doc_id", "text", "body", "_p_new", "findings"]
    got = {}
    for r in out.collect():
        assert got.setdefault(r.doc_id, r.text) == r.text
    assert got[2] is None and got[3] == "" and got[4] == decoys and got[None].startswith("x x ")
    found = dict(zip(PII, got[1].split("; ")))
    for kind, value in PII.items():
        assert found[kind] != value
        if kind != "ip":
            assert re.sub(r"\w", "w", found[kind].split("@")[0]) == re.sub(r"\w", "w", value.split("@")[0])
    assert luhn(found["card"]) and found["email"].endswith("@mail.example.org") and found["phone"].startswith("+44 (")
    assert got[None].split()[-1] == found["ip"] and all(0 <= int(o) < 256 for o in found["ip"].split("."))
    account = found["iban"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1 and account[:2] == "DE"
    day, month, year = map(int, found["date"].split("/"))
    assert 1 <= day <= 31 and 1 <= month <= 12 and 1900 <= year <= 2099
    assert re.fullmatch('token = "[0-9a-f]{32}"', got[5])
    other = {r.doc_id: r.text for r in pii.pseudonymize(docs, "other").collect()}
    assert other[1] != got[1]
    assert pii.pseudonymize(docs.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymize(docs, "")


def test_secrets_are_replaced_whole(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    jwt = ".".join([make(36), make(74), make(43)])
    base64 = make(13) + "+/" + make(25) + "=="
    secrets = [make(129), make(500), make(20_000), jwt, base64, make(15) + "/" + make(24)]
    names = ["token=", "client_secret = ", "password: ", '"access_token": "', "aws_secret_access_key=", "privateKey='"]
    rows = [(f"{n}{s}\" end", s, n) for n in names for s in secrets] + [("monkey: sits_on_a_green_tree", "", "monkey: ")]
    out = pii.pseudonymize(spark.createDataFrame(rows, "text string, was string, name string"), "k").collect()
    assert len(out) == len(rows)
    for r in out:
        if not r.was:
            assert r.text == rows[-1][0] and not r.findings
            continue
        assert r.text.startswith(r.name) and r.text.endswith('" end')
        new = r.text[len(r.name) : -len('" end')]
        assert [f.kind for f in r.findings] == ["secret"] and r.findings[0].value == new
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", new))) == re.sub(
            "[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", r.was)))
        assert not any(r.was[i : i + 8] in new for i in range(len(r.was) - 7))
    same = pii.pseudonymize(spark.createDataFrame([("token=" + "a" * 800,)], "text string"), "k").first().text[6:]
    shifts = [same[i : i + 64] for i in range(0, 384, 64)]
    assert len(set(shifts)) == 6


def test_permutations_are_one_to_one(spark):
    numbers = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert numbers.select(pii.feistel(F.col("v"), 48, 10, "k", "t").alias("p")).distinct().count() == 10_000
    days = spark.range(pii.DAYS).select(pii._mixed(F.col("id"), pii.DAYS_A_BLOCK, "k", "date").alias("p"))
    assert days.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first() == (pii.DAYS, 0, pii.DAYS - 1)


def hashes(text, size=5):
    words = text.encode().split()
    size = min(size, len(words))

    def chain(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    return {chain(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def test_fingerprints(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(3000)]
    rows = [(9, " ".join(base)), (8, " ".join(base[:2000])), (8, " ".join(base[:2000])), (5, None), (4, ""), (3, "few words"),
            (2, " ".join(base[1000:])), (None, "no id at all here now")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sketch string")
    edited = fingerprints_queries.with_edited(docs)
    order = [9, 8, 5, 4, 3, 2, None]
    by_id = {d: t or "" for d, t in rows}
    keys = {r.key: r for r in edited.collect()}
    assert edited.count() == len(rows)
    for k, d in enumerate(order):
        after = by_id[order[(k + 1) % len(order)]]
        row = keys[-(2**63) if d is None else d]
        assert row.head == after[: len(by_id[d]) // 2]
        assert row.next_sketch == sorted(hashes(after))[: fp.K]
    a, b = (spark.createDataFrame([(by_id[k],)], "t string") for k in (9, 8))
    pair = fp.with_sketch(a, "t", "a").drop("t").crossJoin(fp.with_sketch(b, "t", "b").drop("t"))
    assert python_free(pair)
    A, B = hashes(by_id[9]), hashes(by_id[8])
    r = pair.select(fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("b"), F.col("a")), fp.distinct_shingles(F.col("a"))).first()
    assert abs(r[0] - len(A & B) / len(A | B)) < 0.15 and r[1] > 0.85 and abs(r[2] / len(A) - 1) < 0.3


def test_sketches_merge(spark):
    rng = random.Random(2)
    parts = [" ".join(f"w{rng.randrange(500)}" for _ in range(400)) for _ in range(6)]
    df = fp.with_sketch(spark.createDataFrame([("g", p) for p in parts], "g string, t string"), "t", "s")
    got = fp.merged(df, ["g"], "s").first().s
    assert got == sorted(set().union(*(hashes(p) for p in parts)))[: fp.K]


def test_url_lists(spark):
    def t(day):
        return 86_400 * day

    listed = [("example.com", "block", t(10)), ("example.com", "clear", t(400)), ("example.com/de", "allow", t(20)),
              ("a.example.com", "allow", t(5)), ("a.example.com", "block", t(5)), (None, "block", t(1)), ("x.org", None, t(1)),
              ("x.org", "block", None)]
    entries = spark.createDataFrame([(*e, "x") for e in listed], "pattern string, action string, listed_at long, url string")
    seen = [(1, "https://example.com/", t(9)), (2, "https://example.com/", t(10)), (3, "http://user@b.example.com:80/de/x?q", t(30)),
            (4, "http://example.com/de/x", t(30)), (5, "http://A.example.com/", t(30)), (6, "http://example.com/", t(500)),
            (7, "nonsense", t(30)), (8, None, t(30)), (9, "http://x.org", None), (2, "https://example.com/", t(10))]
    captures = spark.createDataFrame([(*s, "x", "y") for s in seen], "page_id long, url string, fetched_at long, pattern string, bucket string")
    judged = url_filters.judge(captures, entries)
    assert python_free(judged)
    got = sorted(((r.page_id, r.verdict, r.pattern, r.n_active) for r in judged.collect()), key=str)
    want = [(1, "none", None, 0), (2, "block", "example.com", 1), (2, "block", "example.com", 1), (3, "block", "example.com", 1),
            (4, "allow", "example.com/de", 2), (5, "block", "a.example.com", 2), (6, "none", None, 0), (7, "none", None, 0),
            (8, "none", None, 0), (9, "none", None, 0)]
    assert got == sorted(want, key=str)
    assert url_filters.judge(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filters.judge(captures, entries.limit(0)).collect()} == {"none"}


def test_values_are_computed_once(spark):
    df = once(spark.range(3), a=F.col("id") + 1)
    assert [tuple(r) for r in df.collect()] == [(0, 1), (1, 2), (2, 3)]
