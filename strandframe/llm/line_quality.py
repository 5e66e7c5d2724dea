"""Quality rules, line first: lines that look like navigation, boilerplate or noise go, then documents that lose too much.

Everything is a column expression over the row's own text; nothing is exploded
or shuffled.  Repeated five-word windows are found in the row by sorting the
windows' hashes with their places and comparing neighbours; where hashes are
equal the words themselves are compared.

Line rules (a line without a word is neither kept nor lost):

* navigation: at least two bars or arrows, or nothing but a menu word
* boilerplate: cookie, licence, copyright and subscription phrases that fill a fair share of the line
* punctuation: three lines or more in a row of fewer than eight words that end no sentence (a heading alone stays)
* noise: less than half of its characters but spaces are letters or digits
* shouting without a sentence: two or more ``!!`` marks in a row of capitals

Defined results: null, empty and white-space texts have no word, fail the base
rules and have no line; repeated rows and ids are independent; other columns
pass through when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: White space of words and lines.
SPACE = " \t\n\x0b\x0c\r"
#: Fixed values of the rules: patterns and phrases on the line in lower case, and one on the line itself.
NAVIGATION = r"[|»›>→][^\n]*[|»›>→]|^[^a-z]*(home|menu|next|previous|back|login|log in|sign in|sign up|share|search|contact|sitemap|read more|click here|top)[^a-z]*$"
BOILERPLATE = (
    "all rights reserved", "copyright", "©", "cookie", "privacy policy", "terms of use", "terms of service", "subscribe", "newsletter", "javascript",
    "licensed under", "released under", "permission is hereby granted", "spdx-license", "without warranty",
)
COPYRIGHT = r"\(c\) [12][0-9]{3}"
#: A phrase counts in lines of up to this many times its length (for a copyright with its year, ``YEAR`` characters).
FILLS, YEAR = 12, 8
FRAGMENT = r"^[ \x09-\x0D]*[^ \x09-\x0D]+(?:[ \x09-\x0D]+[^ \x09-\x0D]+){0,6}[ \x09-\x0D]*\z"
SENTENCE = r"[.!?…:;。！？]['\")\]»”’]*[ \x09-\x0D]*\z"
SHOUT = r"!![^\n]*!!"
SYMBOLS = "[#*$%&|<>]"
#: Share of word characters that may be lost; words of a document; repeated words of a hundred.
MOST_LOST, LEAST_WORDS, MOST_REPEATED, WINDOW = 0.5, 10, 20, 5


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\x09-\\x0D]+"))


def lines(text: Column) -> Column:
    """Lines with a word, as they are."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def window_hashes(w: str, window: int = WINDOW) -> Column:
    """A hash of every window of the array column ``w``; empty if there is one window at most."""
    args = ", ".join(f"{w}[i - 1 + {k}]" for k in range(window))
    return F.expr(f"CASE WHEN size({w}) > {window} THEN transform(sequence(1, size({w}) - {window - 1}), i -> xxhash64({args})) ELSE cast(array() AS array<bigint>) END")


def repeated_words(w: str, h: str, window: int = WINDOW) -> Column:
    """How many words of the array column ``w`` lie in windows that it holds twice or more, by the column ``h`` of their hashes.

    Only rows with equal hashes are looked at closer, and there only equal words count.
    """
    pairs = f"array_sort(transform({h}, (x, i) -> struct(x AS h, i + 1 AS i)))"
    same = f"slice({w}, p[k].i, {window}) = slice({w}, p[k + %d].i, {window})"
    near = " OR ".join(f"({'k > 0' if d < 0 else 'k < size(p) - 1'} AND p[k + {d}].h = x.h AND {same % d})" for d in (-1, 1))
    # arrays bound once by a one-element transform, since a lambda's body would build them again for each element
    places = f"array_sort(transform(filter(transform(p, (x, k) -> struct(x.i AS i, {near} AS twice)), z -> z.twice), z -> z.i))"
    covered = f"aggregate(q, struct(0 AS n, 0 AS last), (a, i) -> struct(a.n + least({window}, i + {window - 1} - a.last) AS n, i + {window - 1} AS last), a -> a.n)"
    bound = f"transform(array({pairs}), p -> {places})[0]"
    return F.expr(f"CASE WHEN size(array_distinct({h})) = size({h}) THEN 0L ELSE cast(transform(array({bound}), q -> {covered})[0] AS bigint) END")


def bad_line(line: Column, low: Column) -> Column:
    """Whether a rule fails; ``low`` is the line in lower case."""
    size = F.length(line)
    phrase = (size <= FILLS * YEAR) & low.contains("(c) ") & low.rlike(COPYRIGHT)
    for p in BOILERPLATE:
        phrase = phrase | ((size <= FILLS * len(p)) & low.contains(p))
    others = F.length(F.regexp_replace(line, r"[\p{L}\p{N}\s]+", ""))
    letters = F.length(F.regexp_replace(line, r"\s+", "")) - others
    return phrase | (line.contains("!!") & line.rlike(SHOUT)) | ((others > 0) & (letters < others)) | low.rlike(NAVIGATION)


def in_a_row(flags: str) -> Column:
    """A lambda's condition: element ``i`` of the array column ``flags`` and two neighbours of it are true."""
    at = lambda k: f"coalesce(get({flags}, i + {k}), false)"
    return F.expr(f"transform({flags}, (f, i) -> f AND (({at(-1)} AND ({at(-2)} OR {at(1)})) OR ({at(1)} AND {at(2)})))")


def line_quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), clean: str | None = None) -> DataFrame:
    """``keep`` columns, the counts, ``base_failed``, ``lost`` (share of word characters in removed lines) and ``kept``; if named, the text of the lines that stay."""
    made = {"_words", "_lines", "_hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost", "kept", "_text", "_good", "_short", "_row"}
    if set(keep) & made:
        raise ValueError(f"kept columns clash with made ones: {sorted(set(keep) & made)}")
    t = F.col("_text")
    a = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    b = a.select(*keep, "_text", words(t).alias("_words"), lines(t).alias("_lines"))
    short = F.transform("_lines", lambda x: x.rlike(FRAGMENT) & ~x.rlike(SENTENCE))
    b = b.select("*", F.when(F.size("_lines") > 2, short).otherwise(F.array().cast("array<boolean>")).alias("_short"))
    b = b.select("*", F.when(F.size(F.filter("_short", lambda f: f)) > 2, in_a_row("_short")).otherwise(F.array().cast("array<boolean>")).alias("_row"))
    marked = F.zip_with("_lines", "_row", lambda x, r: F.struct(x.alias("x"), F.lower(x).alias("low"), F.coalesce(r, F.lit(False)).alias("row")))
    c = b.select(*keep, "_text", "_words", "_lines", window_hashes("_words").alias("_hashes"), F.filter(marked, lambda p: ~p["row"] & ~bad_line(p["x"], p["low"]))["x"].alias("_good"))
    chars = F.length(F.array_join("_words", "")).cast("long")
    stay = F.length(F.regexp_replace(F.array_join("_good", ""), "[ \\x09-\\x0D]+", "")).cast("long")
    d = c.select(
        *keep, "_good", F.size("_words").cast("long").alias("n_words"), chars.alias("word_chars"), stay.alias("_stay"),
        F.coalesce(F.regexp_count(t, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("_words", "_hashes").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("_stay") / F.col("word_chars")).otherwise(F.lit(0.0))
    e = d.withColumn("base_failed", failed).withColumn("lost", F.round(lost, 6))
    out = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost", (~F.col("base_failed") & (F.col("lost") <= MOST_LOST)).alias("kept")]
    return e.select(*out, *([F.array_join("_good", "\n").alias(clean)] if clean else []))
