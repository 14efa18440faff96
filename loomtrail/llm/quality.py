"""Quality rules: lines are cleaned first, then documents that lost too much are rejected.

A line goes if it

* holds no end of a sentence (Thai marks none, so a line that ends in Thai letters has one), or
* says the same words over and over: its words are cut into runs of ``RUN``, of which those of ten words or
  more stutter if a quarter of them or less are different; more than half of the words lie in such runs, or
* repeats an earlier line of the document.

Within the lines left, a sentence goes if it

* is navigation: three bars or more, and one to ten words at least, or
* consists of symbols or capitals: symbols of ``SYMBOLS`` above a tenth of its characters, or more than
  half of 20 or more Latin letters in capitals, or
* names boilerplate (``BOILERPLATE``) once in ``BOILERPLATE_WORDS`` words or more often.

So no rule depends on the length of a line: sentences on one line are judged as on lines of their own. Lines
without a word left are removed. A document is rejected if fewer than half of its words are left, if it has
fewer than 20 words, or if more than 30 of 100 words lie in 8-word windows that the document repeats.

Results on edge cases: a null or empty text has no words and is rejected; equal rows are judged alike; a
null ``doc_id`` stays null; an empty table gives an empty result; other columns pass through
:func:`clean_documents` and are ignored by :func:`measure`. Texts are judged whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.llm.text_native import SPACE_RUN, SPACES, let, once, windows, words

SYMBOLS = "[#*$%&|<>]"
#: Latin and ellipsis, Arabic and Urdu, Devanagari, Myanmar, Ethiopic, Khmer, Chinese and Japanese marks.
_MARKS = "[.!?\\x{2026}\\x{061F}\\x{06D4}\\x{0964}\\x{0965}\\x{104B}\\x{1362}\\x{1367}\\x{17D4}\\x{3002}\\x{FF01}\\x{FF1F}]"
_CLOSED = _MARKS + "[\"')\\]\\x{201D}\\x{2019}\\x{00BB}]*"
SENTENCE_END = _CLOSED + "([\\x20\\x09-\\x0D]|$)|[\\x{0E01}-\\x{0E5B}][\\x20\\x09-\\x0D]*$"
BOILERPLATE = (
    "(?i)\\b(enable javascript|uses cookies|cookie policy|privacy policy|terms of use|terms of service"
    "|lorem ipsum|click here to|subscribe to our)\\b"
)
BOILERPLATE_WORDS = 40
#: What a sentence that fails holds at least: a symbol, two capitals with one small letter between them at most, or a name.
SUSPICIOUS = SYMBOLS + "|[A-Z][^A-Za-z]*+(?:[a-z][^A-Za-z]*+)?[A-Z]|" + BOILERPLATE
RUN = 64
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _stutters(line: Column) -> Column:
    def judged(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(w) - 1) / RUN).cast("int")), lambda k: F.slice(w, k * RUN + 1, F.lit(RUN))
        )
        bad = F.aggregate(
            runs,
            F.lit(0),
            lambda n, r: n
            + F.when((F.size(r) >= 10) & (F.size(F.array_distinct(r)) * 4 <= F.size(r)), F.size(r)).otherwise(0),
        )
        return F.when(F.size(w) >= 10, bad * 2 > F.size(w)).otherwise(False)

    return let(words(line), judged)


def line_fails(line: Column) -> Column:
    return ~line.rlike(SENTENCE_END) | _stutters(line)


def sentence_fails(sentence: Column) -> Column:
    capitals, letters = _count(sentence, "[A-Z]"), _count(sentence, "[A-Za-z]")
    bars, n_words = _count(sentence, "\\|"), F.size(words(sentence))
    return (
        ((bars >= 3) & (bars * 10 >= n_words))
        | (_count(sentence, SYMBOLS) * 10 > F.length(sentence))
        | ((letters >= 20) & (capitals * 2 > letters))
        | (sentence.rlike(BOILERPLATE) & (F.regexp_count(sentence, F.lit(BOILERPLATE)) * BOILERPLATE_WORDS >= n_words))
    )


def sentences(line: Column) -> Column:
    """The line cut behind the ends of sentences and the white space that follows them."""
    return F.split(F.regexp_replace(line, f"({_CLOSED}[\\x20\\x09-\\x0D]+)", "$1\n"), "\n")


def cleaned(line: Column) -> Column:
    """The line without the sentences that fail; lines that hold nothing suspicious stay as they are."""
    good = F.filter(sentences(line), lambda s: ~(s.rlike(SUSPICIOUS) & sentence_fails(s)))
    return F.when(line.rlike(SUSPICIOUS), F.array_join(good, "")).otherwise(line)


def _repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more: windows sorted by hash lie beside their equals."""
    found = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def places(s: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["at"]))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        let(found, places),
        start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add to the rows: counts of the text, ``clean_text``, ``base_failed`` and ``kept``."""
    own = [c for c in docs.columns if not c.startswith("_q_")]
    df = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(text), F.lit("")).alias("_q_text"))
    df = once(df, _q_words=words(F.col("_q_text")), _q_lines=F.filter(
        F.split("_q_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = once(
        df,
        _q_hashes=windows(F.col("_q_words"), WINDOW),
        _q_clean=F.filter(
            F.transform(F.filter(F.array_distinct("_q_lines"), lambda x: ~line_fails(x)), cleaned),
            lambda x: F.btrim(x, F.lit(SPACES)) != "",
        ),
    )
    n_words = F.size("_q_words").cast("long")
    df = once(
        df,
        _q_n_words=n_words,
        _q_repeat=_repeated_words(F.col("_q_hashes")),
        _q_clean_text=F.array_join("_q_clean", "\n"),
        _q_word_chars=F.length(F.array_join("_q_words", "")).cast("long"),
    )
    n_words = F.col("_q_n_words")
    left = F.size(words(F.col("_q_clean_text"))).cast("long")
    base_failed = (n_words < LEAST_WORDS) | (F.col("_q_repeat") * 100 > n_words * MOST_REPEATED)
    added = {
        "n_words": n_words,
        "word_chars": F.col("_q_word_chars"),
        "n_symbols": _count(F.col("_q_text"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": F.col("_q_repeat"),
        "base_failed": base_failed,
        "n_lines": F.size("_q_lines").cast("long"),
        "n_removed_lines": (F.size("_q_lines") - F.size("_q_clean")).cast("long"),
        "words_left": left,
        "clean_text": F.col("_q_clean_text"),
    }
    df = df.select(*[F.col(f"`{c}`") for c in own if c not in added and c != "kept"],
                   *[c.alias(n) for n, c in added.items()])
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") * 2 >= F.col("n_words")))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their cleaned texts; columns as they came, ``n_chars`` counted anew."""
    judged = measure(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    judged = judged.where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
