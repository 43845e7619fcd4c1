import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from heightline.llm import byte_bpe, matroska, url_filter
from tests.oracle import same

PATH = public_tokenizers.path(byte_bpe.RANKS)


def test_bpe_contract(spark, table, edge_rows):
    enc = byte_bpe.encoding(PATH)
    want = []
    for i, t in edge_rows:
        ids = np.asarray(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    found = map(tuple, byte_bpe.op8_byte_bpe(spark, table(edge_rows)).collect())
    assert sorted(found, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["word \n\n  two\x1c \x85 x" * 50, "  \n " * 300, "a" * 500, "Don't  stop\t\n now \u2003 wide 12345 \U0001f600 " * 40, "\n" * 99 + "x", "x " * 400 + "   "])
@pytest.mark.parametrize("limit", [1, 2, 7, 64])
def test_cuts_are_safe(text, limit):
    enc = byte_bpe.encoding(PATH)
    assert "".join(byte_bpe.pieces(text, limit)) == text
    assert byte_bpe.encode(text, enc, limit).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r\n \u2003"])
def test_long_white_space(blank):
    enc = byte_bpe.encoding(PATH)
    wide = blank * 1_000_000
    for text in ("a" + wide + "b", wide, "a" + wide, wide + "b" + wide + "\x1c" + wide):
        assert enc.decode_bytes(byte_bpe.encode(text, enc).tolist()) == text.encode()
    last = enc.encode_ordinary(wide[-1] + "b")
    ids = byte_bpe.encode("a" + wide + "b", enc).tolist()
    assert ids == enc.encode_ordinary("a") + enc._encode_single_piece(wide[:-1]) + last


@pytest.mark.parametrize("run", [2, 3, 9])
@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r\n", "\xa0\u2003 ", "\x85 ", " \x1c "])
def test_white_space_apart_equals_the_pattern(blank, run):
    enc = byte_bpe.encoding(PATH)
    for n in range(1, 12):
        for text in ("a" + blank * n + "b", blank * n, "1" + blank * n + "'s" + blank * n + "!", blank * n + "\u65e5" + blank * n):
            assert byte_bpe.encode(text, enc, 1, run).tolist() == enc.encode_ordinary(text)


def test_bpe_empty_and_clashing(spark, table, clashing):
    assert byte_bpe.op8_byte_bpe(spark, table([])).collect() == []
    coded = byte_bpe.encode_column(clashing, PATH)
    assert coded.columns == [c for c in clashing.columns if c not in ("text", "ids")] + ["ids"]
    raw = byte_bpe.decode_column(coded, PATH).collect()
    assert {r["decoded"].decode() for r in raw} == {f"some words of document {i} " * 20 for i in range(12)}


def test_media_contract(spark, table, edge_rows):
    found = matroska.op6_media_columns(spark, table(edge_rows)).collect()
    assert len(found) == len(edge_rows)
    want = sorted((repr(i), *described(t)) for i, t in edge_rows)
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == want
    equal = {(r["media_bytes"], r["media_sha256"], r["feature"]) for r in found if r["doc_id"] in (20, 21, 22, 23)}
    assert len(equal) == 1


def described(text):
    raw = (text or "").encode()
    payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


@pytest.mark.parametrize("lacing", [matroska.NO_LACING, matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
@pytest.mark.parametrize("size", [0, 1, 576, 577, 576 * 8, 576 * 8 * 48 + 100, 1_000_003])
def test_round_trip(size, lacing):
    if lacing == matroska.NO_LACING:
        frame = matroska.FRAME * matroska.FRAMES_A_BLOCK
    payload = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    if lacing == matroska.FIXED:
        payload = payload.ljust(-(-size // 576) * 576, b"\xff")
    raw = matroska.mux(payload, lacing) if lacing != matroska.NO_LACING else matroska.mux(payload, matroska.XIPH, frame)
    media = matroska.parse(raw)
    p = media.packets()
    assert media.error is None and b"".join(raw[a : a + n] for a, n in zip(p["byte_offset"].tolist(), p["byte_size"].tolist())) == payload
    assert len(media.cues) == len(media.clusters) and p["cued"].all()
    assert (np.diff(p["timestamp_ns"]) >= 0).all()


def test_unknown_sizes_groups_and_uneven_laces():
    e, u = matroska.element, matroska.unsigned
    frames = [b"a" * 300, b"b" * 7, b"c" * 1200, b"d" * 9]
    blocks = b""
    for kind in (matroska.XIPH, matroska.EBML_LACING):
        body = matroska.vint_bytes(2) + struct.pack(">hB", -3, kind << 1) + matroska.lace_header(frames, kind) + b"".join(frames)
        blocks += e(matroska.BLOCK_GROUP, e(matroska.BLOCK, body) + e(matroska.REFERENCE_BLOCK, b"\x01"))
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    cluster = bytes.fromhex("1F43B675") + unknown + u(matroska.TIMESTAMP, 100) + blocks
    raw = e(matroska.EBML, u(matroska.EBML_VERSION, 1)) + bytes.fromhex("18538067") + unknown + cluster + cluster
    media = matroska.parse(raw)
    p = media.packets()
    assert media.error is None and len(media.clusters) == 2
    assert [raw[a : a + n] for a, n in zip(p["byte_offset"].tolist(), p["byte_size"].tolist())] == frames * 4
    assert set(p["timestamp_ns"].tolist()) == {97_000_000} and not p["keyframe"].any() and set(p["track"].tolist()) == {2}


def test_damaged_files_give_an_error_text(spark):
    whole = matroska.mux(b"z" * 576 * 40)
    rows = [(1, None), (2, b""), (3, whole[: len(whole) // 2]), (4, b"\x00" * 50), (5, b"\xff" * 9), (6, whole)]
    media = spark.createDataFrame(rows, "k int, media binary")
    found = {r["k"]: r for r in matroska.read_back(media).collect()}
    assert found[6]["error"] is None and found[6]["payload_bytes"] == 576 * 40
    assert found[3]["error"] and found[4]["error"] and found[1]["payload_bytes"] == 0
    counts = {r["k"]: r["count"] for r in matroska.packet_table(media, "k").groupBy("k").count().collect()}
    assert counts[6] == 40 and 1 not in counts


def test_media_columns_clash(spark, clashing):
    stored = matroska.store(clashing)
    assert stored.columns == [c for c in clashing.columns if c not in ("text", "media", "n_bytes")] + ["n_bytes", "media"]
    assert matroska.read_back(stored).where("error is null").count() == 12


def test_media_empty(spark, table):
    assert matroska.op6_media_columns(spark, table([])).collect() == []


PAGES = "page_id long, url string, html string"
URLS = [None, "", "no scheme", "http://example.com/en/7", "HTTP://EXAMPLE.COM/en/7?q=1", "https://a.b.Example.com/en/71/x#y", "http://example.com/en/8", "http://xexample.com/en/7", "http://com/en/", "http://com/EN/", "http://a.net/de/", "http://example.net/de/8", "http://net/de", "ftp://x.org/es/?a=/en/", "http://x.org?/es/", "http://x.org#/es/", "http://x.org", "://org/es/", "http://example.com:80/en/7", "http://user@example.com/en/7", "http://x.com//en/", "http://a/b://c.com/en/", "http://É.com/en/ü"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    import re

    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_contract(spark, table):
    rows = [(i, u, "") for i, u in enumerate(URLS * 2)] + [(None, URLS[3], None)]
    folder = table(rows, PAGES, "pages")
    found = url_filter.op9_url_filters(spark, folder)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, *judged(u)) for i, u, _ in rows), key=repr)
    python = [x for x in ("Python", "Arrow", "Pandas") if x in found._jdf.queryExecution().toString()]
    assert not python


def test_url_rules_are_the_contracts(spark, table):
    urls = {"http://x.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://x.org/es/1": ("org/es/", "block")}
    found = url_filter.op9_url_filters(spark, table([(i, u, "") for i, u in enumerate(urls)], PAGES, "pages"))
    assert [(r["rule"], r["verdict"]) for r in found.orderBy("page_id").collect()] == list(urls.values())


def test_url_oracle(spark, sf_dir):
    same(url_filter.op9_url_filters(spark, sf_dir), url_filter.ORACLE, sf_dir)


def test_url_rules_of_other_kinds(spark):
    rules = [url_filter.Rule("block", "bad.example", ""), url_filter.Rule("allow", "bad.example", "/ok"), url_filter.Rule("block", "x-y.com", "/a.b/")]
    urls = ["http://bad.example", "http://bad.example/ok", "http://bad.example/okay", "http://www.bad.example/no", "http://bad.example.org", "http://x-y.com/a.b/c", "http://x-y.com/aab/c"]
    df = spark.createDataFrame([(u, "h", 1, 2) for u in urls], "url string, Host string, _target int, _fit int")
    found = url_filter.filter_urls(df, rules)
    got = {r["url"]: r["verdict"] for r in found.collect()}
    assert [got[u] for u in urls] == ["block", "allow", "allow", "block", "allow", "block", "allow"]
    assert {"_target", "_fit", "host", "rule"} <= set(found.columns)
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_url_empty(spark, table):
    assert url_filter.op9_url_filters(spark, table([], PAGES, "pages")).collect() == []


def _file(cluster: bytes, info: bytes = b"") -> bytes:
    m = matroska
    return m.element(m.EBML, b"") + m.element(m.SEGMENT, info + m.element(m.CLUSTER, cluster))


def test_a_block_shorter_than_its_header_is_an_error_text():
    good = matroska.unsigned(matroska.TIMESTAMP, 0) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")
    for body in (b"\x81", b"\x81\x00", b"\x81\x00\x00", b"\x81\x00\x00\x06"):
        found = matroska.parse(_file(good + matroska.element(matroska.SIMPLE_BLOCK, body)))
        packets = found.packets()
        assert len(packets["track"]) == 1 and found.error
    empty = matroska.parse(_file(good + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80")))
    assert empty.packets()["byte_size"].tolist() == [3, 0] and not empty.error


def test_a_timestamp_beyond_64_bits_is_an_error_text():
    late = matroska.element(matroska.TIMESTAMP, b"\xff" * 8) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")
    found = matroska.parse(_file(late))
    assert found.error and not len(found.packets()["track"])
    wide = matroska.element(matroska.TIMESTAMP, b"\x01" * 9)
    assert matroska.parse(_file(wide)).error
    cue = matroska.element(matroska.CUES, matroska.element(matroska.CUE_POINT, matroska.element(matroska.CUE_TRACK_POSITIONS, matroska.element(matroska.CUE_CLUSTER_POSITION, b"\xff" * 8))))
    assert not matroska.parse(_file(b"", cue)).packets()["cued"].any()


def test_a_scale_beyond_64_bits_is_an_error_text(spark):
    scaled = matroska.element(matroska.INFO, matroska.element(matroska.TIMESTAMP_SCALE, b"\xff" * 8))
    good = matroska.unsigned(matroska.TIMESTAMP, 0) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")
    for raw in (_file(b"", scaled), _file(good, scaled), _file(good) + scaled):
        media = matroska.parse(raw)
        media.packets()
        assert media.error or raw.endswith(scaled)
    found = matroska.read_back(spark.createDataFrame([(1, _file(good, scaled))], "k int, media binary")).collect()
    assert found[0]["error"]


def test_long_and_repeated_urls(spark):
    """One URL on most rows, and one of a megabyte."""
    wide = "http://example.com/en/8" + "a/" * 500_000
    rows = [(i, "http://www.net/de/x") for i in range(3000)] + [(5000, wide), (5001, None)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 3002 and all(got[i]["verdict"] == "block" for i in range(3000))
    assert (got[5000]["rule"], len(got[5000]["path"])) == ("com/en/", len(wide) - len("http://example.com")) and got[5001]["host"] == ""
