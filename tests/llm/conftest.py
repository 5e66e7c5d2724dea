import os
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

ODD = [
    None, "", " ", "   ", "\n", "a", "A", "é", "the  the", " lead", "trail ", "tab\tand\x0bmore\x0c\r\n", "\x1c\x1d x \x85 y z w", "日本語のテキスト" * 40,
    "😀👩‍👩‍👧 é é", "x" * 3000, "ab" * 700, "=" * 500, "12345678901234567890" * 9, "it's we'll I'm 's'd", "²³½ Ⅷ ٣٤ ๑", "\u0000 nul \u0000", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "▁▁a ▁b", "word\n\n\nword \n x", "ﬁ Å 　 x", "a" * 65 + " " + "b" * 64, "1 22 333", "_under_ __x", "퟿", "A.B.C!?", "foo.\nBar  baz",
]


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """A tables' folder with nulls, empty and long texts, ties and repeated rows."""
    d = tmp_path_factory.mktemp("odd")
    texts = ODD + ODD[:6] + ["the quick brown fox jumps over the lazy dog and runs away from here now"] * 3
    ids = [*range(len(texts) - 4), 5, 5, 5, None]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en", None, "de"] * (len(texts) // 3) + ["en"] * (len(texts) % 3)), "source": ["s"] * len(texts), "n_chars": pa.array([None] * len(texts), pa.int64())})
    pq.write_table(docs, d / "documents.parquet")
    bench = pa.table({"item_id": pa.array([1, 2, 3, 4], pa.int64()), "text": ["brown fox jumps over the lazy dog and runs away from", "", None, "tab and"]})
    pq.write_table(bench, d / "benchmark.parquet")
    html = [None, "", "<p>a<p>b", "<article>x</article>", "no markup", "<nav>m</nav><main>x", "<p>" + "long " * 20_000, *["<div class=m>same</div><p>own"] * 7]
    urls = [None, "", "http://a.example/", "https://A.example:8/x", "not an address", *["http://b.example/x"] * (len(html) - 5)]
    pq.write_table(pa.table({"page_id": pa.array([*range(len(html) - 1), None], pa.int64()), "url": urls, "html": html}), d / "pages.parquet")
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (100, 0, "user", "base"), (101, 0, "user", ""), (None, 1, "user", "lost"), (-3, 5, "a", "é" * 500), (199, None, "user", "base")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    pq.write_table(pa.table({n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "role", "text"), zip(*turns), kinds)}), d / "conversations.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory, odd_dir):
    d = tmp_path_factory.mktemp("none")
    for t in ("documents", "benchmark", "pages", "conversations"):
        pq.write_table(pq.read_table(f"{odd_dir}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)


def rows_of(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
