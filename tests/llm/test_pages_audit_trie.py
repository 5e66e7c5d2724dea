"""Site style trees, source audit and prefix trie against plain versions, on odd rows and given tables."""

import hashlib
import html as H
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandframe.llm import prefix_trie, site_tree, source_audit
from strandframe.llm.audit_queries import op12_source_audit
from strandframe.llm.page_queries import op11_site_tree
from strandframe.llm.trie_queries import op13_prefix_trie
from tests.llm.conftest import SF

# ---- pages ---------------------------------------------------------------------------------------


def article(source):
    """Text of the plain articles of the given pages."""
    inner = re.search("<article>(.*?)</article>", source, re.S)[1]
    blocks = [re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x) for x in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(filter(None, (" ".join(H.unescape(x).split()) for x in blocks)))


def test_pages_of_the_table(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = op11_site_tree(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def page(body, extra=""):
    return f"<html><head><title>t</title></head><body>{body}{extra}"


SHAPES = [
    ("<p>a <b>bo</b>ld &amp; x&nbsp;y<br>z<p>two", "a bold & x y z\ntwo"),
    ("<nav>menu</nav><main><h1>T</h1><p>x</main><footer>f</footer>", "T\nx"),
    ("<header>site</header><article><header><h1>T</h1></header>x<aside>no</aside></article>", "T\nx"),
    ('<div class="content with-sidebar"><article class="post tag-social"><p>x</article></div><div class="sidebar"><p>no</div>', "x"),
    ('<article>x<article class="comment"><p>no</article></article><div id="comments"><article>no</article></div>', "x"),
    ('<p>x<span class="ad">no</span> y<div role="navigation">no</div><div hidden>no</div><div style="display: none">no</div>', "x\ny"),
    ("<script>if (a</b) '</p>'</script><style>p{}</style><!-- no --><form>no<input></form><p>x < y", "x < y"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><p>x", "x"),
    ('<p title="a>b" data-x=\'c>d\'>x</p></b></div><p>y', "x\ny"),
    ("", ""), ("<p>  </p>", ""), ("<scr", "<scr"), ("<!-- open <p>x", ""), ("no markup", "no markup"),
]


@pytest.mark.parametrize("source,want", SHAPES)
def test_one_page(source, want):
    assert site_tree.text_of(page(source), set()) == want
    assert site_tree.text_of(None, {1}) == ""


def site(k, words):
    rng = random.Random(k)
    text = "".join(f"<p>{' '.join(rng.choices(words, k=9))}</p>" for _ in range(rng.randint(2, 4)))
    return page(f"<div class=q><b>{['Deals', 'Offers'][k % 2]} of the day</b></div><div class=z{k}>{text}</div><div class=x>We are Foo &copy; {2000 + k % 2}</div>"), text


def test_statistics_remove_what_pages_share(spark):
    words = [f"w{i}" for i in range(500)]
    made = [site(k, words) for k in range(12)]
    rows = [(k, f"http://A.example:80/{k}", h) for k, (h, _) in enumerate(made)] + [(90, "http://b.example/", made[0][0]), (91, None, made[0][0]), (92, "http://a.example:80/x", None), (93, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["_page"]["page_id"]: r["text"] for r in site_tree.extract(pages).collect()}
    for k, (_, text) in enumerate(made):
        assert got[k] == text.replace("</p><p>", "\n")[3:-4]
    assert got[90] == got[91] and got[90].startswith("Deals of the day\n") and "We are Foo" in got[90]
    assert got[92] == "" and got[93] == ""
    assert site_tree.extract(pages.limit(0)).count() == 0


def plain_importances(sources, least_pages=0):
    """The style tree of one host by recursion."""
    style, content, m, kids = defaultdict(Counter), defaultdict(Counter), Counter(), defaultdict(set)
    for s in sources:
        p = site_tree.Page(s)
        path = [()]
        below = defaultdict(list)
        for i in range(1, len(p.up)):
            path.append((*path[p.up[i]], p.label[i]))
            below[p.up[i]].append(p.label[i])
            kids[path[p.up[i]]].add(path[i])
        seen = defaultdict(set)
        for i, x in enumerate(path):
            seen[x].add(tuple(k for k, _ in groupby(below[i])))
        for x, st in seen.items():
            m[x] += 1
            style[x][tuple(sorted(st))] += 1
        for x, t in {(path[e], t) for e, t, _, _ in p.blocks}:
            content[x][t] += 1

    def entropy(counts, base):
        return -sum(c / base * math.log(c / base, base) for c in counts)

    def comp(x):
        n = m[x]
        read = None if not content[x] else 1.0 if n == 1 else 1 - sum(math.log(c, n) for c in content[x].values()) / len(content[x])
        if not kids[x]:
            return read or 0.0
        share = site_tree.GAMMA ** len(style[x])
        parts = [(m[k], comp(k)) for k in kids[x]] + ([(n, read)] if read is not None else [])
        return (1 - share) * (1.0 if n == 1 else entropy(style[x].values(), n)) + share * sum(a * b for a, b in parts) / sum(a for a, _ in parts)

    return Counter((m[x], round(comp(x), 9)) for x in m)


def test_importances_by_recursion(spark):
    words = [f"w{i}" for i in range(40)]
    sources = [site(k, words)[0] + ("<ul><li>a<li>b</ul>" if k % 3 else "<p>x") for k in range(9)]
    pages = spark.createDataFrame([("h", s) for s in sources] + [("one", sources[0])], "host string, html string")
    got = Counter((r["m"], round(r["importance"], 9)) for r in site_tree.importances(pages).filter("host = 'h'").collect())
    assert got == plain_importances(sources)
    one = Counter((r["m"], round(r["importance"], 9)) for r in site_tree.importances(pages).filter("host = 'one'").collect())
    assert one == plain_importances(sources[:1])


# ---- audit ---------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups.add((lang, source))
        count[lang, source].update(TERM.findall(low))
        docs[lang].update(set(TERM.findall(low)))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        v = len(kept)
        peers = [s for g, s in groups if g == lang]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        own = shares(count[lang, source])
        whole = shares(sum((count[lang, s] for s in peers), Counter()))
        other = {s: shares(count[lang, s]) for s in peers if s != source}
        values = {s: sum((own[t] - q[t]) ** 2 // q[t] for t in kept) for s, q in other.items()}
        above = {t: (own[t] - whole[t]) ** 2 // whole[t] for t in kept if count[lang, source][t] and own[t] > whole[t]}
        for part, x, top in (("pair", values, None), ("term", above, 200)):
            order = sorted(x.items(), key=lambda k: (-k[1], k[0].encode()))
            out |= {(lang, source, part, i, n, r) for r, (i, n) in enumerate(order[:top], 1)}
    return out


@pytest.mark.parametrize("block", [50_000, 7])
def test_audit_of_odd_rows(spark, block):
    rng = random.Random(5)
    words = ["the", "The", "ünï", "日本", "a1b", "x", "y", "z", "Ａ", "q-r", "Zebra", "ß"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "S1"])) for _ in range(120)]
    rows += [(None, "fr", "s1"), ("", "fr", None), ("one two", "fr", "s9"), ("alone alone", "xx", "s"), ("w " * 50_000, "en", "s1")] + [("the end", "it", "a")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS block", "4 AS id")
    got = source_audit.audit(docs, block=block)
    assert set(map(tuple, got.collect())) == plain_audit(rows)
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_gallop_and_shares():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, n))) for n in (9, 300))
        where = {int(x): i for i, x in enumerate(b)}
        assert source_audit.gallop(a, b).tolist() == [where.get(int(x), -1) for x in a]
    n = np.array([0, 1, 5, 10**15], np.int64)
    assert source_audit.shares(n, 3 * 10**15).tolist() == [1 + 10**9 * (int(x) + 1) // (3 * 10**15) for x in n]


def test_audit_of_the_table(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert set(map(tuple, op12_source_audit(spark, SF).collect())) == plain_audit(rows)


# ---- trie ----------------------------------------------------------------------------------------


def digest(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def plain_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), digest(r, x), (r or "", x or "")))
    turns = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items())


def odd_conversations():
    rng = random.Random(11)
    says = ["hi", "hello", "", None, "日本", "x" * 30, "😀"]
    rows = []
    for c in [*range(0, 260), *range(-140, -90), 5_000_000_000]:
        if c == 100:
            continue  # no base
        n = 1 if c == 200 else rng.choice([1, 2, 3, 7, 9])
        for t in range(n):
            rows.append((c, None if rng.random() < 0.1 else t // 2 if c % 7 == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(says[: 2 if c % 3 else 7])))
    rows += [(3, 0, "user", "hi")] * 4 + [(None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(777, t, "user", "again") for t in range(900)]  # a third of all turns in one conversation
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [100_000, 40])
def test_trie_of_odd_rows(spark, limit):
    rows = odd_conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS id", "3 AS d", "4 AS w")
    assert Counter(map(tuple, prefix_trie.trie(table.repartition(5), limit=limit).collect())) == plain_trie(rows)
    assert prefix_trie.trie(table.limit(0)).count() == 0


def test_trie_of_the_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    assert Counter(map(tuple, op13_prefix_trie(spark, SF).collect())) == plain_trie(rows)


def test_centroid_sums():
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 10, 200, 3000]:
        for deep in (1, 5, n):
            up = np.array([i if i == 0 or rng.random() < 0.02 else max(0, i - 1 - rng.integers(0, deep)) for i in range(n)])
            own, heavy = rng.integers(0, 9, (n, 2)), rng.integers(1, 4, n)
            depth, want, weight = np.zeros(n, np.int64), own.copy(), heavy.copy()
            for i in range(n):
                depth[i] = 0 if up[i] == i else depth[up[i]] + 1
            for i in range(n - 1, -1, -1):
                if up[i] != i:
                    want[up[i]] += want[i]
                    weight[up[i]] += weight[i]
            assert np.array_equal(prefix_trie.centroid_sums(up, depth, weight, own), want)


def test_finished_takes_components_whole(monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIMIT", 4)
    rows = []
    for c in range(5):
        top = b"%d" % c
        rows += [(top, None, top, 0, 3, 0, 1), (top + b"a", top, top, 1, 2, 0, 1), (top + b"b", top + b"a", top, 2, 1, 1, 1)]
    cols = list(zip(*rows))
    kinds = [pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "up", "comp", "d", "w", "leaf", "save"])
    zero = pa.array([0] * len(rows), pa.int64())
    batch = batch.append_column("add_leaf", zero).append_column("add_save", zero)
    out = [r for b in prefix_trie._finished(batch.slice(i, 2) for i in range(0, 15, 2)) for r in b.to_pylist()]
    assert sorted((r["id"], r["leaves"], r["saved"]) for r in out) == sorted((i, 1, w) for i, _, _, _, w, _, _ in rows)
