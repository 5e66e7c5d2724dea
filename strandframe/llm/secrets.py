"""Secrets: fixed patterns, and values in credential contexts rated by their guess cost.

The base kinds (``assign access hex``) stay as their patterns find them.  The
method looks at values in credential contexts and takes those that would need at
least ``10 ** LEAST`` guesses: the minimum over all segmentations into dictionary
words, dates, repeats, keyboard walks and brute-force spans of the product of the
parts' guesses, by dynamic programming.  Contexts are a credential word before the
value (kind ``guess``), a bearer header (``bearer``) and the password part of an
address (``url``).  Private-key blocks (``key``) and tokens with a published prefix
(``token``) need no context.  Placeholders such as ``changeme`` or ``aaaa1111`` stay
below.  Values that touch a base span are not listed again, but base spans carry
their value's cost as score.

The dictionary is what people choose and, for prose of any language, the corpus's own
words: those of at least ``LEAST_DOCS`` documents outside credential contexts, the
``MOST_WORDS`` most frequent of them, counted over all documents and ranked by count.

The programme looks back at most ``REACH`` places for a part, and besides to the
start of the repeat, walk or periodic run that ends at a place, however long, so
it is linear in the value's length.

Defined results: null and empty texts have no spans; rows are independent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe.llm import spans as S
from strandframe.session import cut_lineage

BASE = ("assign", "access", "hex")
LEAST = 9.0
REACH = 24
#: Distinct words whose counts a task holds at once.
HELD = 500_000
#: Documents that a learned word must be in, words learned at most (their ranks stand for guesses), and letters of one.
LEAST_DOCS, MOST_WORDS, WORD = 5, 50_000, (4, REACH)

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"[0-9a-f]{16,}+")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth|private[_-]?key|access[_-]?key|bearer|login)["']?(?:\x20*+[:=]\x20*+|\x20is\x20)["']?([^\s"'`,;<>(){}\[\]]{6,}+)""",
    re.I | re.A,
)
BEARER = re.compile(r"\bbearer\x20++([A-Za-z0-9._~+/=-]{12,}+)", re.I | re.A)
ADDRESS = re.compile(r"(?<=://)[^\s/:@]{1,64}+:([^\s/@]{6,128}+)@")
#: Prefixes that issuers publish, and what follows.
KNOWN = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})")
BEGIN, END = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
RUN = re.compile(r"[^\W\d_]+")
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.]?[01][0-9][-/.]?[0-3][0-9])?|[0-3][0-9][-/.]?[01][0-9][-/.]?(?:19|20)[0-9]{2}")

#: Words people choose, the most common first.
WORDS = (
    "password 123456 qwerty admin welcome letmein login master dragon monkey football baseball shadow sunshine princess iloveyou secret hello "
    "freedom whatever trustno trust pass test guest root user changeme change default example sample token key api auth access private public "
    "service server database system network computer internet company office home work money love angel summer winter spring autumn january "
    "february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "red green blue black white orange silver gold star power super magic happy lucky tiger eagle flower cookie cheese coffee chocolate banana "
    "apple google amazon linux windows android your name here my the and for you this that null none true false insert replace value string "
    "redacted hidden placeholder todo fixme undefined"
).split()
#: English words and the parts that long words are made of, so that prose behind ' is ' stays cheap.
ENGLISH = (
    "ing ed er est ly al ally able ably ible ibly tion ation ition sion ment ness ity ive ative ous ious ful less ship hood ance ence ant ent ary ery ory ism ist ize ized ise ised ify ified ial ical ically "
    "un re in im dis mis pre pro con com sub super inter over under out auto anti counter trans multi semi non fore mid self ex "
    "act age aim air arm art ask back base bear been before begin behind believe between beyond body book both bound break bring broad build call care carry case cast cause cent center chance charge check child "
    "circum class clear close code collect color come common complete compute concern condition configure connect consider contain content continue control correct cover create credit current custom cycle "
    "date deal decide deep define deliver depend deter develop differ direct discover document door down draw drive during each easy educate effect eight either element else employ encrypt end enter environ equal "
    "establish estimate ever every exact except expect experience explain express extra face fact fair fall familiar far feel field figure file fill final find fine finish fire first fix flex follow force form format "
    "forward found frame frequent friend from front full function further general gener generate give govern grade grand graph great group grow hand hard head hear help here high hold how human identify immediate "
    "important impossible include increase independent indicate individual industry inform initial input install instead institute integer interest intro involve issue itself join judge keep kind know language large "
    "last late law lead learn leave length letter level life light like limit line list literal live local log long look made maintain make manage mark master material matter mean measure medium meet member mention method might "
    "mini mix mode model modern modify moment more most move must natural near necessary need never next normal note nothing notice number object observe obtain obvious occur offer often open operate opinion order "
    "organ original other ought own pack paper part particular pass pattern people perfect perform perhaps period permanent permit person phrase physical pick place plain plan play point polit popular port position possible "
    "post potential power practice prefer prepare present press pretty prevent previous principle print privilege probable problem process produce product profess program project proper propose protect prove provide public "
    "publish purpose put question quick quite random range rate rather reach read ready real reason receive recent recommend record refer reflect refresh regular relate relation release remain remember remove replace report "
    "represent require research respect respond responsible rest result retrieve return reveal right round rule run same save scient search section secure see select send sense sent separate serious serve service set seven "
    "several share short should show sign significant similar simple simply since single situation size small social some sometimes soon sort sound source space speak special specific specify stand standard start state station "
    "statement stay step still stop store straight strange strong struct structure study subject success such sufficient suggest supply support suppose sure surface surprise switch table take talk teach team tech technical "
    "temporary term text than their them then therefore these they thing think third those thought three through throughout time together too total touch toward trade tradition train transfer travel treat tree trouble try turn type "
    "typical unique unit universal until update upon usual usually valid value various vary version very view visit voice wait walk want warn watch water way week well were what when where whether which while whole wide will "
    "wish with within without wonder word world would write wrong year yet young auth authent icate icated authentic matic mathematics necessarily essential basically available accessible acceptable beautiful confidential"
).split()
#: Rows of a keyboard, walked either way.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789", "1qaz", "2wsx", "3edc", "4rfv")
LEET = str.maketrans("4310$@57!", "aeiosastl")
NEXT = {a + b for r in ROWS for w in (r, r[::-1]) for a, b in zip(w, w[1:])}


class Rater:
    """Guess costs under the fixed words and ``learned`` ones, the most frequent first."""

    def __init__(self, learned: tuple[str, ...] | list[str] = ()):
        self.rank = {w: k + 1 for k, w in enumerate(dict.fromkeys((*WORDS, *ENGLISH)))}
        for k, w in enumerate(learned):
            self.rank[w] = min(self.rank.get(w, len(WORDS) + k + 1), len(WORDS) + k + 1)
        self.longest = max(map(len, self.rank))
        self.cost = lru_cache(maxsize=50_000)(self._cost)

    def part(self, part: str, low: str) -> float:
        """log10 of the guesses of one part by the cheapest pattern that it fits, else as brute force."""
        n = len(part)
        best = float(n)  # brute force: ten guesses a character
        if n <= self.longest:
            for w, extra in ((low, 0.0), (low.translate(LEET), 0.5)):
                if w in self.rank:
                    best = min(best, log10(self.rank[w] + 1) + extra + (0.3 if part != low else 0.0))
        if n >= 3:
            if low == low[0] * n:
                best = min(best, 1.0 + log10(n))
            elif all(low[i : i + 2] in NEXT for i in range(n - 1)):
                best = min(best, 1.2 + log10(n) + 0.2 * (n > 6))
            else:
                for k in (2, 3, 4):  # a short group again and again
                    if n % k == 0 and n >= 2 * k and low == low[:k] * (n // k):
                        best = min(best, k + log10(n // k))
        if 4 <= n <= 10 and DATE.fullmatch(part):
            best = min(best, 2.0 if n == 4 else 4.5)
        return best

    def _cost(self, value: str) -> float:
        """log10 of the guesses for a value: the cheapest segmentation, with a little for each part."""
        low, n = value.lower(), len(value)
        if len(low) != n:  # a letter that lower-cases to two
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        best = [0.0] * (n + 1)
        walk, runs = 0, [0, 0, 0, 0]  # where the walk and the runs of period 1 to 4 that end here start
        for j in range(1, n + 1):
            best[j] = best[j - 1] + 1.0
            if j > 1 and low[j - 2 : j] not in NEXT:
                walk = j - 1
            if j - walk > REACH:
                best[j] = min(best[j], best[walk] + 1.4 + log10(j - walk) + (0.3 if walk else 0.0))
            for k in (1, 2, 3, 4):
                if j > k and low[j - 1] != low[j - 1 - k]:
                    runs[k - 1] = j - k
                i = runs[k - 1] + (j - runs[k - 1]) % k
                if j - i > REACH:
                    best[j] = min(best[j], best[i] + k + log10((j - i) // k) + (0.3 if i else 0.0))
            for i in range(max(0, j - REACH), j - 1):
                c = best[i] + self.part(value[i:j], low[i:j]) + (0.3 if i else 0.0)
                if c < best[j]:
                    best[j] = c
        return round(best[n], 3)


FIXED = Rater()
guess_cost = FIXED.cost
KINDS = (*BASE, "guess", "bearer", "url", "key", "token")


def blocks(text: str) -> list[tuple[int, int]]:
    """Private-key blocks; one without an end reaches to the end of its last line of key letters."""
    out, at = [], 0
    while m := BEGIN.search(text, at):
        e = END.search(text, m.end())
        nxt = BEGIN.search(text, m.end())
        if e and not (nxt and nxt.start() < e.start()):
            at = e.end()
        else:
            at = re.compile(r"[\sA-Za-z0-9+/=]*").match(text, m.end()).end()
        out.append((m.start(), at))
    return out


def find(text: str, rater: Rater = FIXED) -> list[S.Span]:
    """All spans by start, then kind as listed in ``KINDS``."""
    cost = rater.cost
    out = [("assign", m.start(), m.end(), cost(m[1])) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [("access", m.start(), m.end(), cost(m[0][4:])) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end(), cost(m[0])) for m in HEX.finditer(text)]
    taken = [(a, b) for _, a, b, _ in out]

    def offer(kind: str, a: int, b: int, least: float = LEAST) -> None:
        if b - a >= 6 and not any(a < y and x < b for x, y in taken) and (c := cost(text[a:b])) >= least:
            out.append((kind, a, b, c))
            taken.append((a, b))

    if "-----BEGIN" in text:
        for a, b in blocks(text):
            out.append(("key", a, b, float(b - a)))
            taken.append((a, b))
    for m in KNOWN.finditer(text):
        offer("token", *m.span(), 0.0)
    if "://" in text:
        for m in ADDRESS.finditer(text):
            offer("url", *m.span(1))
    for m in BEARER.finditer(text):
        offer("bearer", *m.span(1))
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".!?:":  # the sentence's, not the value's
            b -= 1
        offer("guess", a, b)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def words_of(text: str) -> set[str]:
    """Plain words of a text outside credential contexts, in lower case: all small letters, or but the first."""
    low, high = WORD
    runs = {w for w in RUN.findall(CONTEXT.sub(" ", text)) if low <= len(w) <= high}
    return {w.lower() for w in runs if w[1:].islower() and len(w.lower()) == len(w)}


def common_words(docs: DataFrame, text: str = "text", least: int = LEAST_DOCS, most: int = MOST_WORDS) -> list[str]:
    """Words of at least ``least`` documents, most frequent first (ties by the alphabet): counts over all documents, summed in each task first.

    There are ``most`` at most: words of the count that would pass that number, and of lower ones, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict({"word": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})
            count.clear()
            return b

        for b in batches:
            for t in b.column(0):
                count.update(words_of(t.as_py() or ""))
                if len(count) > HELD:
                    yield out()
        if count:
            yield out()

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted.filter(F.col("n") >= least))
    classes = counted.groupBy("n").agg(F.count("*").alias("words"))  # one row for each count that occurs
    reach = classes.withColumn("up_to", F.sum("words").over(W.orderBy(F.desc("n"))))
    cut = reach.filter(F.col("up_to") <= most).agg(F.min("n")).first()[0]
    if cut is None:
        return []
    return [r["word"] for r in sorted(counted.filter(F.col("n") >= cut).collect(), key=lambda r: (-r["n"], r["word"].encode()))]


_RATERS: dict[int, Rater] = {}


def _rater(key: int, words: list[str]) -> Rater:
    """The rater of this worker for a dictionary that was sent to it."""
    if key not in _RATERS:
        _RATERS.clear()
        _RATERS[key] = Rater(words)
    return _RATERS[key]


def secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "found", clean: str | None = None, words: list[str] | None = None) -> DataFrame:
    """``keep`` columns, spans ``found`` (kind, start, end, log10 of guesses as score) and, if named, the text with spans replaced.

    ``words`` is the dictionary besides the fixed one; if it isn't given it is learned from all of ``docs``.
    """
    words = common_words(docs, text) if words is None else words
    shared = docs.sparkSession.sparkContext.broadcast(words)  # MOST_WORDS words at most
    key = hash(tuple(words))

    def finder():
        rater = _rater(key, shared.value)
        return lambda t: find(t, rater)

    return S.found(docs, finder, text, keep, name, clean)
