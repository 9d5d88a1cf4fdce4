"""Training-data operators on small fixtures against brute force, and on awkward input."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.oracle import compare, connect
from tidemark.llm import (
    bitplanes, byte_bpe, frames, host_quality, main_text, ngram_join, packing, pieces, pseudonyms, severity_model, vector_tiles, warc_bundles,
)
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

RANKS, VOCABULARY = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, class string, n_words string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long_text = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [
        (1, base, "s1"), (1, base, "s1"), (2, base.upper(), "s1"), (3, base + " thirteen", "s2"), (4, None, "s1"), (5, "", None),
        (6, " \t\n", "s2"), (7, "hello", "s2"), (8, "hello", "s2"), (9, long_text, "s1"), (10, long_text + " end", "s1"),
        (None, base, "s1"), (None, None, None), (11, "idiot " * 12, "s1"), (12, "a\nb c\na\nb c\n\n", "s2"), (13, "日本語 é x" * 3, "s2"),
    ]
    return spark.createDataFrame([(i, t, "en", s, 0, False, "x", "y") for i, t, s in texts], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


# 1 host quality


def test_repeat_words_counts_positions_once():
    assert host_quality.repeat_words("a b c d e".split()) == 0
    assert host_quality.repeat_words("a b c d e x a b c d e".split()) == 10
    assert host_quality.repeat_words(["a"] * 7) == 7


def test_host_quality_awkward(awkward, empty):
    rows = host_quality.judged(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert (by[4].n_words, by[4].base_failed, by[4].kept) == (0, True, False)
    assert by[12].n_dup_lines == 2 and by[1].kept
    assert host_quality.judged(empty).count() == 0
    kept = host_quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 9, 10]  # four of five other documents of s2 fail


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 else "bad", "en", "spam") for i in range(100)] + [(100 + i, good, "en", f"h{i % 9}") for i in range(90)]
    judged = host_quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in judged if r.kept} == set(range(100, 190))
    assert all(r.host_rejected == (r.doc_id < 100) for r in judged)


def test_prior_pulls_small_hosts_to_the_mean():
    prior = host_quality.beta_prior(hosts=100, docs=10_000, failed=1000, docs_squared=100 * 100.0**2, rate_squared=100 * 10.0**2 / 100)
    assert prior.alpha / (prior.alpha + prior.beta) == pytest.approx(0.1)
    assert (1 + prior.alpha) / (1 + prior.alpha + prior.beta) < 0.5


# 2, 4, 8 tokens


def encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_both_libraries():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    tik, ids_of, coder = encoder(), pieces.PieceIds(VOCABULARY), byte_bpe.Coder(RANKS)
    assert pieces.PATTERN == public_tokenizers.PATTERN
    random.seed(3)
    letters = "ab '\n\t \x1c\x85 é²½ß日́١ !?_<|endoftext|>Ⅷǆ﻿😀"
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(400)] + ["a" * 700, "", "I'll don't\r\n\n x  "]
    for text, coded in zip(texts, coder.encode(texts)):
        expected = tik.encode_ordinary(text)
        assert tokenizer.encode(text, add_special_tokens=False).ids == expected
        assert np.frombuffer(ids_of.encode(text), "<u2").tolist() == expected
        assert np.frombuffer(coded, "<u4").tolist() == expected


def test_added_tokens_as_the_library_reads_them(spark):
    """The tokenizer is as loaded: its added tokens are found in texts, alone, side by side and between blanks."""
    from tokenizers import Tokenizer

    tokenizer, ids_of = Tokenizer.from_file(VOCABULARY), pieces.PieceIds(VOCABULARY)
    random.seed(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "one", " two", "é日", "'s", "12", "!", "<|"]
    texts = ["one<|endoftext|>two", "<|endoftext|>", " <|endoftext|> <|ENDOFTEXT|>"] + ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(400)]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [505, 50256, 11545]
    assert [np.frombuffer(ids_of.encode(t), "<u2").tolist() for t in texts] == expected

    df = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    told = [(i, len(e) + 1, zlib.crc32(np.array(e + [2], "<u4").tobytes())) for i, e in enumerate(expected[:40])]
    starts = np.cumsum([0] + [n for _, n, _ in told]).tolist()
    rows = sorted(bitplanes.written_and_read(df, VOCABULARY).collect())
    assert [tuple(r) for r in rows] == [(i, s, n, c) for (i, n, c), s in zip(told, starts)]
    for r in packing.packed(df, VOCABULARY).collect():
        ids = expected[r.doc_id] + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_byte_bpe(awkward, empty, documents):
    tik = encoder()
    for df in (awkward, documents):
        found = collections.Counter(map(tuple, byte_bpe.round_trip(df, RANKS).collect()))
        expected = collections.Counter()
        for r in df.collect():
            ids = np.array(tik.encode_ordinary(r.text or ""), "<u4")
            expected[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert found == expected
    assert byte_bpe.round_trip(empty, RANKS).count() == 0


@pytest.mark.parametrize("long", [65, byte_bpe.LONG])
def test_long_words(monkeypatch, long):
    """Runs of one letter, pairs that overlap and random letters, by single steps and by all places of a rank."""
    monkeypatch.setattr(byte_bpe, "LONG", long)
    tik, coder, rng = encoder(), byte_bpe.Coder(RANKS), random.Random(5)
    alphabets = ["a", "ab", "aab", "=-", "etaoin", "日本語中", "éèàe", "abcdefghijklmnopqrstuvwxyz"]
    words = ["".join(rng.choices(alphabets[i % 8], k=rng.randint(65, 260))) for i in range(160)]
    words += ["".join(rng.choices(a, k=2_500)) for a in alphabets] + ["日本" * 20_000, "=" * 100_000]
    for word, coded in zip(words, coder.encode(words)):
        assert np.frombuffer(coded, "<u4").tolist() == tik.encode_ordinary(word)


def test_decoding_in_stretches(monkeypatch):
    monkeypatch.setattr(byte_bpe, "DECODED", 7)
    coder = byte_bpe.Coder(RANKS)
    texts = ["ein langer Text über mehrere Stücke hinweg", "", "kurz", "日本語"]
    out = [b""] * 4
    for doc, data in coder.decoded(coder.encode(texts)):
        out[doc] += data
    assert [o.decode() for o in out] == texts


def test_packing(awkward, empty, documents):
    tik = encoder()
    for df in (awkward, documents):
        rows = packing.packed(df, VOCABULARY).collect()
        windows = collections.defaultdict(list)
        for r in rows:
            windows[r.sequence_id].append((r.offset, r.length))
        for parts in windows.values():
            ends = 0
            for offset, length in sorted(parts):
                assert offset == ends and length > 0
                ends += length
            assert ends <= packing.CAPACITY
        expected = collections.Counter((r.doc_id, tuple(tik.encode_ordinary(r.text or "") + [1])) for r in df.collect())
        found = collections.defaultdict(list)
        for r in rows:
            found[r.doc_id].append(r)
        for (doc, ids), times in expected.items():
            covered = collections.Counter()
            for r in found[doc]:
                if r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32:
                    covered.update(range(r.start, r.start + r.length))
            assert all(covered[i] >= times for i in range(len(ids)))
        assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in expected.items())
    assert packing.packed(empty, VOCABULARY).count() == 0


def test_packing_takes_the_smallest_sum_of_squares():
    random.seed(5)
    windows = packing.Windows(capacity=12)
    for doc in range(400):
        size = random.randint(1, 11)
        before = windows.levels.copy()
        best = min(
            sum(x * x for h, x in enumerate(_moved(before, level, size)) if 0 < h < 12)
            for level in range(0, 13 - size) if level == 0 or before[level]
        )
        windows.add(doc, np.zeros(size, "<u2"))
        assert sum(int(x) ** 2 for x in windows.levels[1:12]) == best


def _moved(levels, level, size):
    out = levels.tolist()
    if level:
        out[level] -= 1
    out[level + size] += 1
    return out


@pytest.mark.parametrize("kind", [bitplanes.BYTES, bitplanes.BITS])
def test_planes_round_trip(kind):
    random.seed(7)
    for n in (1, 5, 8, 4097):
        ids = np.array([random.choice([0, 1, 50256, 2**32 - 1, 77]) for _ in range(n)], "<u4")
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", [bitplanes.BYTES, bitplanes.BITS])
def test_id_files(awkward, documents, monkeypatch, kind):
    tik = encoder()
    for df in (awkward, documents):
        rows = bitplanes.written_and_read(df, VOCABULARY, kind).collect()
        expected = []
        for r in df.collect():
            ids = np.array(tik.encode_ordinary(r.text or "") + [2], "<u4")
            expected.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(expected, key=str)
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id if r.doc_id is not None else -1 for r in sorted(rows, key=lambda r: r.start)]
        assert ids == sorted(ids)


def test_id_file_reads_ranges(tmp_path, empty):
    import pyarrow as pa

    writer, every = bitplanes.Writer(), np.arange(200_000, dtype="<u4")
    for at in range(0, 200_000, 1000):
        writer.add(at, every[at : at + 1000])
    (tmp_path / "x").write_bytes(writer.finished())
    reader = bitplanes.Reader(pa.OSFile(str(tmp_path / "x")))
    assert (reader.ids(65_000, 70_000) == every[65_000:135_000]).all() and len(reader.ids(5, 0)) == 0
    assert all((ids == every[s : s + 1000]).all() and n == s for n, s, ids in reader.documents())
    assert bitplanes.written_and_read(empty, VOCABULARY).count() == 0


# 3 main text


PAGE = """<!DOCTYPE html><html><head><title>T t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu one</a></li></ul></nav><div class="ad">buy now or later</div><article><h1>Head &amp; line</h1>
<p>First  <b>bold</b>\n text&#33;<p>Second<br>line</p><script>x("<p>no</p>")</script><div class="comments"><p>nice one</p></div></article>
<footer>&copy; foot words here and more words</footer></body></html>"""


def test_main_text(spark):
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p></p>"), (None, "u", "just words"), (1, "u", PAGE), (6, "u", "<p>open <b>tags & < signs")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    weights = main_text.train(pages)
    out = {r.page_id: r.text for r in main_text.extracted(pages, weights).collect()}
    expected = "Head & line\nFirst bold text!\nSecond\nline"
    assert out == {1: expected, 2: "", 3: "", 4: "", None: "just words", 6: "open tags & < signs"}
    assert main_text.main_text(plain, weights).startswith("Head & line")
    assert main_text.extracted(pages.limit(0), main_text.train(pages.limit(0))).count() == 0


def page_text(html):
    """The words of a page outside what is left out, whatever the region."""
    page = main_text.Page(html)
    return page.text(0, len(page.keys))


@pytest.mark.parametrize("page, words", [
    ('<p>a b c</p><svg class="i"/><p>rest of article</p>', "a b c\nrest of article"),
    ('<p>a b c</p><svg><title/><path d="m"/><path d="n"/></svg><p>rest of it</p>', "a b c\nrest of it"),
    ('<p>a b c</p><svg><style>p{}</style><metadata>rdf</metadata><text>axis</text></svg><p>rest of it</p>', "a b c\naxis\nrest of it"),
    ("<p>a b c d</p><video-player src=x></video-player><p>rest</p>", "a b c d\nrest"),
    ("<select-menu>one two three</select-menu><object-view>x y</object-view> <title-bar>four</title-bar>", "one two threex y four"),
    ("<p>the sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is big</p>", "the sum x+y is big"),
    ("<object data=x><param name=a>fall back words</object> and <audio src=y>no sound</audio> <video>no film", "fall back words and no sound no film"),
    ("<p>a b c</p><select><option>x<option>y</select><template><p>t u v</p></template><p>d e f g</p>", "a b c\nd e f g"),
    ("<p>a b c</p><script>x('<p>')", "a b c"), ("<p>a b c</p><textarea>t</textarea ><p>d e f</p>", "a b c\nd e f"),
])
def test_raw_elements_end_where_they_end(page, words):
    assert page_text(page) == words


@pytest.mark.parametrize("kind", [
    "no-sidebar", "content with-sidebar", "post comments-open", "single-post no-comments", "has-banner", "social-science", "sidebar", "ad",
])
def test_class_names_of_page_and_content(kind):
    words = "all words of this page"
    for name in ("html", "body", "main", "article"):
        assert page_text(f'<{name} class="{kind}"><p>{words}</p></{name}>') == words
    for name in ("main", "article"):
        assert page_text(f'<div id="{kind}">lead <{name}><p>{words}</p></{name}></div>') == f"lead\n{words}"
    if kind not in ("sidebar", "ad"):
        assert page_text(f'<div class="{kind}"><p>{words}</p></div>') == words


@pytest.mark.parametrize("kind", ["ad", "box ads", "comments", "comments-area", "comment_list", "cookie-banner", "Sidebar", "nav-links"])
def test_left_out_classes(kind):
    part = f'<div class="{kind}"><p>so much other text in here</p></div>'
    assert page_text(f"<p>one two three four</p>{part}<p>five six seven eight nine</p>") == "one two three four\nfive six seven eight nine"


def test_comments_in_articles():
    page = '<main><article><p>one two three four</p></article><div id="comments"><article class="comment">me too, me too, me too</article></div></main>'
    assert page_text(page) == "one two three four"


def test_best_region_is_the_best():
    random.seed(2)
    for _ in range(200):
        scores = [random.randint(-4, 4) for _ in range(random.randint(0, 12))]
        a, b = main_text.best_region(scores)
        assert sum(scores[a:b]) == max([0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    import html

    for r in QUERIES["op3_main_text"](spark, SF_DIR).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h1|br)\b)[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 5 pseudonyms


def test_pseudonyms(spark, awkward, empty):
    texts = [
        "card 4785380592391139, 4785-3805-9239-1139 and not 2123465659789240", "tel +1 (743) 555-3824 or +1 743-555-3824",
        "a.b19@mail5.example.com at 152.143.123.131 not 999.1.1.1", "1984-02-29 29/02/1984 29.02.1984 30/02/1984",
        'token = "d7c90f3602a3d0b907ff" DE89370400440532013000', "ssn 123-45-6789 000-12-1234", "clean words only 12 3.", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = pseudonyms.pseudonymised(df, "k")
    out = [r.text for r in new.orderBy("doc_id").collect()]
    assert [r.text for r in pseudonyms.pseudonymised(new, "k", inverse=True).orderBy("doc_id").collect()] == texts
    assert out[6:] == texts[6:] and "2123465659789240" in out[0] and "999.1.1.1" in out[2] and "30/02/1984" in out[3] and "000-12-1234" in out[5]
    first, second = re.findall(r"\d[\d-]{15,}", out[0])[:2]
    assert first == second.replace("-", "") != "4785380592391139"
    assert len({re.sub(r"\D", "", p) for p in out[1][4:].split(" or ")}) == 1
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", out[3]).groups()
    assert f"{d}/{m}/{y}" in out[3] and f"{d}.{m}.{y}" in out[3]
    # format and length stay
    assert [re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", t))) for t in out[:2]] == [
        re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", t))) for t in texts[:2]
    ]
    assert pseudonyms.pseudonymised(awkward, "k").columns == awkward.columns
    assert sorted(map(str, pseudonyms.pseudonymised(awkward, "k").collect())) == sorted(map(str, awkward.collect()))
    assert pseudonyms.replaced(empty, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    """All dates of a century, and all pairs of small symbols, go to different ones."""
    days = spark.range(36525).selectExpr("date_format(date_add(date'1930-01-01', int(id)), 'yyyy-MM-dd') AS v")
    new = days.select(pseudonyms.pseudonym(F.col("v"), "k").alias("n"))
    row = new.agg(F.countDistinct("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert tuple(row) == (36525, "1930-01-01", "2029-12-31")


# 6 WARC


def test_warc(spark):
    rows = [(3, "http://x/1", "same"), (1, "http://x/2\r\nInjected: 1", "same"), (2, None, ""), (5, "u", None), (None, "u", "same"), (4, "u", "x" * 600_000), (4, "u", "y"), (6, "u", "é")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder_index = warc_bundles.write_bundles(pages, warc_bundles.fresh_folder(spark, "warc-test")).localCheckpoint()
    out = collections.Counter(tuple(r)[:1] + tuple(r)[2:] for r in warc_bundles.read_bundles(folder_index).collect())

    def row(page, text, first=None):
        data = text.encode()
        return page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if first is not None else "response", first

    assert out == collections.Counter(
        [row(3, "same", 1), row(1, "same"), row(2, ""), row(5, "", 2), row(None, "same", 1), row(4, "x" * 600_000), row(4, "y"), row(6, "é")]
    )
    place = folder_index.filter("page_id = 6").first()
    fields, block = warc_bundles.read_record(place.bundle, place.frame, place.offset)
    assert fields["WARC-Record-ID"] == "<urn:page:6>" and block.endswith("é".encode())
    assert warc_bundles.written_and_read(pages.limit(0)).count() == 0


def test_bundle_is_plain_zstandard():
    """Any Zstandard reader sees the records one after another, and none of the seek table."""
    import zstandard

    bundle = warc_bundles.Bundle()
    data = [warc_bundles.record(i, "u", b"z" * 100_000, "D", None) for i in range(9)]
    places = [bundle.add(d) for d in data]
    assert len({frame for frame, _ in places}) > 1
    with zstandard.ZstdDecompressor().stream_reader(bundle.finished(), read_across_frames=True) as plain:
        assert plain.read() == b"".join(data)


# 7 vectors


def test_vector_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_tiles, "BLOCK", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0, 0.02, 0.1])).tolist(), int(i % 12) // 6) for i in range(300)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [], 1), (None, rows[0][1], 0), (906, rows[0][1] + [0.0], 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, embedding array<double>, label int, copies int")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_tiles.near_duplicates(df).collect()}
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    root = frames.forest(300, *np.nonzero(link))
    for i in range(300):
        assert out[i] == (int(link[i].sum()) - 1, int(root[i]), int(root[i]) == i)
    assert all(out[i] == (0, i, True) for i in range(900, 907)) and out[None] == (0, None, True)
    assert vector_tiles.near_duplicates(df.limit(0)).count() == 0


def test_quantised_bound_never_rules_out_a_link():
    rng = np.random.default_rng(4)
    for dim in (3, 64, 2000):
        x = rng.normal(size=(60, dim))
        x = np.vstack([x, x + rng.normal(size=x.shape) * 0.15])
        u = vector_tiles.unit(x)
        q = vector_tiles.quantised(u)
        found = set(zip(*(a.tolist() for a in vector_tiles.possible(q, q, 0.98))))
        assert {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.98))} <= found


# 9 severity


def test_severity_on_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    model = severity_model.train(docs, labels.filter("doc_id % 3 != 0"))
    held = severity_model.graded(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = [r.toxic == bool(r.toxic_label) for r in ((x if False else _Row(x)) for x in held)]
    assert sum(right) / len(right) > 0.9
    assert model.thresholds == sorted(model.thresholds)
    assert all(0 <= r["severity"] <= 2 for r in held)


class _Row:
    """Both columns named ``toxic`` of a joined row."""

    def __init__(self, row):
        names = row.__fields__
        self.toxic, self.toxic_label = (row[i] for i, n in enumerate(names) if n == "toxic")


def test_severity_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = severity_model.train(awkward, none)
    rows = severity_model.graded(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r.severity == 0 and r.kept for r in rows)
    odd = spark.createDataFrame([(1, None, None), (11, 0, 1), (11, 1, None), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["id"]: r["grade"] for r in severity_model.graded_labels(odd).collect()} == {1: 0, 11: 2, 99: 2}
    assert severity_model.keep_civil(awkward, severity_model.train(awkward, odd)).columns == awkward.columns
    assert severity_model.graded(empty, model).count() == 0


def test_shared_weights_and_ordered_thresholds():
    random.seed(9)
    sets, grades = [], []
    for _ in range(600):
        grade = random.choice([0, 0, 0, 1, 2])
        sets.append({f"w{random.randint(0, 200)}" for _ in range(20)} | set(random.sample(["bad", "worse", "vile"], grade)))
        grades.append(grade)
    model = severity_model.fit(sets, np.array(grades), np.ones(600), least_z=3.0)
    low, mid, high = (sum(model.probabilities(t)) for t in ("plain text", "bad text", "bad worse vile text"))
    assert low < 0.5 < mid < high and model.thresholds == sorted(model.thresholds)


# 10 n-gram join


def brute_links(rows):
    """doc_id to (set size, smallest doc_id reachable); repeated ids are one document."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for doc, text in rows:
        words = word.findall((text or "").translate(low))
        sets.append((doc, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    ids = sorted({d for d, _ in sets})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return collections.Counter((d, len(s), find(d)) for d, s in sets)


def near_copies(seed, groups, sizes, change):
    random.seed(seed)
    rows, doc = [], 0
    for g in range(groups):
        base = [f"g{g}w{i}" if i % 3 else random.choice("abcdefgh") for i in range(random.choice([6, 40, 120]))]
        for _ in range(random.choice(sizes)):
            words = list(base)
            for _ in range(random.randint(0, change)):
                words[random.randrange(len(words))] = f"x{random.randint(0, 9)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("run, salted", [(32, None), (3, None), (2, 0)])
def test_ngram_join(spark, monkeypatch, run, salted):
    """Few and many classes on one shingle, salted or not, give the same components."""
    monkeypatch.setattr(ngram_join, "RUN", run)
    if salted is not None:
        entries = ngram_join.prefix_entries
        monkeypatch.setattr(ngram_join, "prefix_entries", lambda d, s, _: entries(d, s, 3))
    rows = near_copies(run, 14, [1, 2, 5, 40], 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collections.Counter(map(tuple, ngram_join.linked(df).collect())) == brute_links(rows)


def test_ngram_join_awkward(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect() if r.doc_id is not None]
    found = ngram_join.linked(awkward).collect()
    assert collections.Counter(tuple(r) for r in found if r.doc_id is not None) == brute_links(rows)
    assert sorted((r.n_shingles, r.component_id) for r in found if r.doc_id is None) == [(0, None), (8, None)]
    assert ngram_join.linked(empty).count() == 0
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    # the row of the first text that has no id is a copy of document 1 and goes
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 11, 12, 13]


def test_suffix_filter_never_rules_out_a_link():
    rng = np.random.default_rng(6)
    for n in (1, 4, 5, 63, 700):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: max(1, int(len(x) * 0.9))], rng.integers(0, 2**63, len(x) // 10).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            assert ngram_join.may_overlap(ngram_join._bounds(x), ngram_join._bounds(y), len(x), len(y))


@pytest.mark.parametrize("dealt", [50, frames.DEALT])
def test_components(spark, dealt):
    """By star steps, and by contraction alone."""
    random.seed(11)
    edges = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)]
    ids = list(range(0, 300))
    found = dict(map(tuple, frames.components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long").repartition(6), dealt).collect()))
    root = frames.forest(300, *np.array(edges).T)
    assert found == {i: int(root[i]) for i in ids}


def changed_copies(n, seed=1, words=120, changed=2):
    """Copies of one text with some words changed: most pairs meet on common shingles, few link."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(words), changed):
            own[k] = f"own{rng.randrange(10**6)}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("together", [7, 2048])
def test_components_of_a_frequent_shingle_in_blocks(spark, monkeypatch, together):
    monkeypatch.setattr(ngram_join, "TOGETHER", together)
    rows = changed_copies(150) + [(1000 + i, t + " tail " * 3) for i, t in changed_copies(40, 2, 60, 3)]
    found = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, found)) == brute_links(rows)


def test_rows_between_components_grow_with_the_group(spark, monkeypatch):
    """Pairs of a group of near copies are compared, but never become rows."""
    told = []
    plain = ngram_join._between_components

    def counted(*args):
        out = plain(*args).persist()
        told.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_between_components", counted)
    candidates = []
    verified = ngram_join.verified

    def pairs_of(pairs, *args):
        candidates.append(pairs.distinct().count())
        return verified(pairs, *args)

    monkeypatch.setattr(ngram_join, "verified", pairs_of)
    for n in (250, 500, 1000):
        ngram_join.linked(spark.createDataFrame(changed_copies(n), "doc_id long, text string")).collect()
    assert all(t < 40 * n for t, n in zip(told, (250, 500, 1000))) and len(told) == 3
    assert candidates[1] < 2.5 * candidates[0] and candidates[2] < 2.5 * candidates[1]


def test_parity_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (3, 60, 700):
        x, y = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([y, x[: n // 2]]))
        a, b = ngram_join.parity_sketches([x, y], 256)
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
        assert not np.bitwise_count(a ^ ngram_join.parity_sketches([x], 256)[0]).any()


def test_keep_one_loses_no_text(spark):
    """Repeated and missing ids, clashing and dotted names, texts without words."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [
        (1, a), (1, b), (2, b + " end"), (None, a), (None, a), (None, "c " + " ".join(f"c{i}" for i in range(20))), (3, ""), (3, ""), (None, None),
        (4, "only these"), (4, "only these"), (5, "only these"),
    ]
    schema = "doc_id long, text string, gone_id long, `a.b` string, row string, own_id int, `q``x` int"
    df = spark.createDataFrame([(i, t, 9, "x", "r", 1, 2) for i, t in rows], schema).repartition(3)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    found = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in kept.collect()))
    c = rows[5][1]
    assert found == sorted([(1, a), (1, b), (-1, c), (3, ""), (3, ""), (-1, ""), (4, "only these")])
    assert ngram_join.keep_one(df.limit(0)).collect() == []
