from heightline.sources import envelopes as E


def push(b):
    return bytes([len(b)]) + b if len(b) < 0x4C else b"\x4c" + bytes([len(b)]) + b if len(b) < 256 else b"\x4d" + len(b).to_bytes(2, "little") + b


def envelope(*pushes, end=b"\x68"):
    return E.OPENING + b"".join(map(push, pushes)) + end


def test_envelopes_of_a_script():
    text = {"content_type": "text/plain", "content_string": "ab"}
    key = push(b"k" * 32) + b"\xac"
    assert E.envelopes(key + envelope(b"\x01", b"text/plain", b"", b"a", b"b")) == [text]
    assert E.envelopes(key + E.OPENING + b"\x51" + push(b"text/plain") + b"\x00" + push(b"ab") + b"\x68" + envelope(b"", b"\xff")) == [text, {"content_type": None, "content_string": None}]
    assert E.envelopes(envelope(b"\x01", b"text/plain")) == [{"content_type": "text/plain", "content_string": None}]
    assert E.envelopes(envelope(b"", b"x" * 300, b"y" * 80)) == [{"content_type": None, "content_string": "x" * 300 + "y" * 80}]
    assert E.envelopes(envelope(b"", b"a", end=b"")) == [] and E.envelopes(envelope(b"", b"a", end=b"\xac\x68")) == [] and E.envelopes(E.OPENING + b"\x4d\xff") == []
    assert E.envelopes(push(E.OPENING) + b"\x68") == [] and E.envelopes(b"") == []


def test_inscriptions_are_counted_through_a_transaction(spark):
    one, two = envelope(b"\x01", b"t", b"", b"{}"), envelope(b"", b"2") + envelope(b"", b"3")
    rows = [
        (9, 0, "t", 1, [b"sig", two, b"\xc0"]), (9, 0, "t", 0, [one, b"\xc0", b"\x50annex"]), (9, 1, "u", 0, [b"sig", b"\xc0"]), (9, 2, "v", 0, None),
        (9, 3, "w", 0, [one]), (9, 4, "x", 0, []), (9, 5, "y", 0, [None, b"\xc0"]), (9, 6, "z", 0, [one, None]),
    ]
    df = spark.createDataFrame(rows, "height bigint, tx_index int, txid string, input_index int, witness array<binary>")
    got = {r.inscription_id: (r.inscription_number, r.content_type, r.content_string) for r in E.read_envelopes(df).collect()}
    assert got == {"ti0": (0, "t", "{}"), "ti1": (1, None, "2"), "ti2": (2, None, "3"), "zi0": (0, "t", "{}")}
    assert E.read_envelopes(df.limit(0)).count() == 0
