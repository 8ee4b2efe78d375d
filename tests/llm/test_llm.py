"""Brute force, round trips, held-out accuracy and odd rows for the training-data operators."""

import hashlib
import random
import re

import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import decontamination, html_text, language, licenses, near_dedup, pieces, pii, secrets, token_counts, transport_stream

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, spans string, bands string"
ODD = [
    (1, None, None, None, None, None, None, None),
    (None, "A null key.", "en", "s", 1, "x", "y", "z"),
    (2, "", "en", None, 0, None, None, None),
    (3, "Ünïcode ▁ text\nwith password = abcdef0123456789 and a.b@c.de", "de", "s", 3, "x", None, None),
    (3, "Ünïcode ▁ text\nwith password = abcdef0123456789 and a.b@c.de", "de", "s", 3, "x", None, None),
    (4, "long " * 60_000, "en", "s", 300_000, None, None, None),
    (5, "*** 1 2 3 ???", "en", "s", 3, None, None, None),
]
PER_ROW = {
    "tokens": lambda d: token_counts.count_tokens(d, P.path("word_bpe_49k.json")),
    "pieces": lambda d: pieces.piece_digests(d, P.path("piece_bpe_32k.model")),
    "encoded": lambda d: pieces.decode_pieces(pieces.encode_pieces(d, P.path("piece_bpe_32k.model")), P.path("piece_bpe_32k.model")),
    "media": lambda d: transport_stream.stream_features(transport_stream.write_streams(d)),
    "streams": lambda d: transport_stream.read_streams(transport_stream.write_streams(d)),
    "pii": pii.find_pii,
    "secrets": lambda d: secrets.scan(d)[0],
    "language": lambda d: language.predict(d, language.learn(d)),
    "near": near_dedup.near_duplicates,
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", PER_ROW)
def test_odd_and_no_rows(spark, name):
    assert len(PER_ROW[name](spark.createDataFrame(ODD, SCHEMA)).collect()) == len(ODD)
    assert PER_ROW[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_stages_keep_columns_and_survive_odd_rows(spark):
    import corpus_pipeline

    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == spark.createDataFrame([], SCHEMA).columns
            docs = near_dedup.written(docs)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


CLASHING = ["score", "lang_pred", "ambiguous", "__text", "__masked", "masked", "__leaks", "leaks", "__id", "__k", "__rows", "__maybe", "maybe", "content", "count", "of_key", "page", "bits", "bands"]


def test_stages_keep_clashing_columns_and_choose_rows(spark, documents):
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    own = documents.where("lang = 'en' and length(text) > 500").orderBy("doc_id").limit(30).select("doc_id", "text", "lang", "source", "n_chars")
    first, second = [r.text for r in own.orderBy("doc_id").limit(2).collect()]
    more = [(1_000_001, None, "en", "s", 0), (1_000_002, "12 34 ??", "en", "s", 8), (1_000_003, first, "en", "s", 1), (1_000_004, first + " and a few words more", "en", "s", 1), (1_000_005, f"{second[:400]} {item} {second[400:500]}", "en", "s", 1)]
    more += [(1_000_006, "Please write to someone@example.org about the herons that wait near the old mill in the rain today, before they leave.", "en", "s", 1)]
    docs = own.unionByName(spark.createDataFrame(more, own.schema)).withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in CLASHING})
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = near_dedup.written(stage(spark, docs, SF))
        assert docs.columns == before and docs.where(" or ".join(f"`{c}` <> concat('{c} ', doc_id)" for c in CLASHING)).isEmpty()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not {1_000_001, 1_000_002} & kept[0] and {1_000_003, 1_000_005, 1_000_006} <= kept[0]
    assert not {1_000_003, 1_000_004} & kept[1] and 1_000_005 in kept[1]
    assert 1_000_005 not in kept[2] and kept[2] == kept[3]
    masked = docs.where("doc_id = 1000006").first()
    assert masked.text.startswith("Please write to [EMAIL] about") and masked.n_chars == len(masked.text)


def fuzz(alphabet, n, most, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


MARKS = ["a", "ing", " ", "  ", "\n", "\t", "é", "é", "Σ", "İ", "<|endoftext|>", "</s>", "▁", "\x1c", "\x00", "　", "\xa0", "😀", "한", "'s", "'LL", "12", "ﬁ", "--", "@", "<0x0A>"]


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    t, table = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_counts.PieceTable(P.path("word_bpe_49k.json"), 9_000)
    for s in fuzz(MARKS, 500, 25):
        assert table.count(s) == len(t.encode(s, add_special_tokens=False).ids), s


def test_pieces_equal_the_library():
    import sentencepiece

    sp, table = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), pieces.ChunkTable(P.path("piece_bpe_32k.model"), 9_000)
    for s in fuzz(MARKS, 500, 25):
        ids = [*sp.encode(s), sp.eos_id()]
        assert table.round_trip(s) == (" ".join(map(str, ids)), sp.decode(ids)), s
        table.turn()


def test_tables_are_bounded_by_bytes():
    """Texts without spaces, and many words."""
    limit, r = 200_000, random.Random(8)
    tokens, chunks = token_counts.PieceTable(P.path("word_bpe_49k.json"), limit), pieces.ChunkTable(P.path("piece_bpe_32k.model"), limit)
    assert tokens.by_words and tokens.ascii_rule and not chunks.whole
    texts = ["".join(r.choice("語言模型的訓練資料一二三") for _ in range(2000)) for _ in range(40)] + [" ".join(f"{r.randrange(10**9):x}" for _ in range(300)) for _ in range(40)]
    for t in texts:
        assert tokens.count(t) == tokens.of_text(t)
        chunks.round_trip(t)
        chunks.turn()
        for table in (tokens.words, tokens.old, tokens.pieces, chunks.ids, chunks.old):
            assert sum(len(k) + len(str(v)) + 200 for k, v in table.items()) < 3 * limit and max(map(len, table), default=0) <= 64


def test_other_tokenizers_go_to_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2, " ": 3}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Split("b", "isolated")
    t.save(str(tmp_path / "t.json"))
    table = token_counts.PieceTable(str(tmp_path / "t.json"))
    assert not table.by_words
    for s in ("a b a", "abab", "", " b "):
        assert table.count(s) == len(t.encode(s, add_special_tokens=False).ids)


def test_pii_equals_the_rules():
    anchors = pii.automaton()
    alphabet = ["a@b.c", "@", "@@", "a@b", ".", "a.b", "-", "1.2.3", "İ", "://", "+1 555 123 4567", "+", "1.2.3.4", "4111111111111111", " ", "12", "255", "300", "(", ")", "%", "é"]
    for s in fuzz(alphabet, 1500, 15):
        want = []
        for kind, rule, holds in (("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(p) <= 255 for p in v.split("."))), ("card", pii.CARD, pii.is_card), ("phone", pii.PHONE, pii.is_phone)):
            want += [(m.start(), kind, m.end()) for m in rule.finditer(s) if holds(m[0])]
        assert [x for x in pii.find(s, anchors) if x[1] in pii.BASE_KINDS] == sorted(want, key=lambda x: (x[0], pii.KINDS.index(x[1]))), s
    spans = pii.find("IBAN: DE89 3704 0044 0532 0130 00 and https://u@a.example.com/x?y.", anchors)
    assert [k for _, k, _ in spans] == ["account", "address", "email"]


def test_pii_takes_time_in_proportion():
    import time

    anchors = pii.automaton()
    shapes = ["a" * 1000 + "@", "1" * 1000, "://", "+1 (", "1.1.1.", "a@", "account ", "@a.", "http://", "1" * 30 + "x", "- 1", "a.a@a.a"]
    for shape in shapes:
        took = []
        for n in (100_000, 800_000):
            began = time.thread_time()
            pii.find((shape * (n // len(shape) + 1))[:n], anchors)
            took.append(time.thread_time() - began)
        assert took[1] < 24 * took[0] + 0.5, (shape, took)
    found = pii.find("Tax ID 12-3456789, KONTONUMMER 0532013000; Passport No. X1234567", anchors)
    assert [k for _, k, _ in found] == ["account"] * 3


def test_secrets_and_ledger(spark):
    texts = fuzz(["token", " = ", "secret: ", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", " ", "é", "x", "😀"], 200, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, new = secrets.scan(docs)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), k, m.end()) for k, (_, _, e, g, least) in enumerate(secrets.RULES) for m in re.finditer(e, t) if len(m[g]) >= least]
        assert got[i] == sorted(want), t
    ledger = near_dedup.written(new)
    again, more = secrets.scan(docs, ledger=ledger)
    assert more.count() == 0 and {r.doc_id: [tuple(s) for s in r.spans] for r in again.collect()} == got
    # a new version of a rule is scanned alone, and so are new texts (one of them in two rows)
    rules = [(k, 2 if k == "hex" else v, e, g, least) for k, v, e, g, least in secrets.RULES]
    extra = docs.union(spark.createDataFrame([(900, "token = 0123456789abcdef"), (901, "token = 0123456789abcdef"), (902, None)], docs.schema))
    again, more = secrets.scan(extra, ledger=ledger, rules=rules)
    blobs = {r.blob for r in ledger.collect()}
    assert {(r.kind, r.blob in blobs) for r in more.collect()} == {("hex", True), *((k, False) for k in secrets.KINDS)} and more.count() == len(blobs) + 3 + 3 * ("" not in texts)
    got |= {900: [(0, 0, 24), (8, 2, 24)], 901: [(0, 0, 24), (8, 2, 24)], 902: []}
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in again.collect()} == got


def test_many_secrets_in_a_text(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, " é ".join(f"{i:016x}" for i in range(n)))] + [(2, "x " * k + "0123456789abcdef " * k) for k in (127, 128, 129, 256, 257)], "doc_id long, text string")
    for r in secrets.scan(docs)[0].collect():
        text = next(t for t in ([x.text for x in docs.where(F.col("doc_id") == r.doc_id).collect()]) if secrets_sha(t) == r.blob)
        assert [tuple(s) for s in r.spans if s.kind == 2] == [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]


def secrets_sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_streams_round_trip():
    for n in (0, 1, 63, 64, 183, 16_000, 16_384, 16_385, 100_000):
        payload = transport_stream.padded(bytes(i * 7 % 256 for i in range(n)))
        stream = transport_stream.mux(payload)
        got = transport_stream.demux(stream)
        assert got["payload"] == payload and len(got["pts"]) == len(got["random_access"]) == -(-len(payload) // transport_stream.UNIT)
        assert got["pts"] == [(k + 1) * transport_stream.TICKS for k in range(len(got["pts"]))] and got["random_access"] == list(range(0, len(payload), transport_stream.UNIT))
        assert transport_stream.demux(stream[:-188] + b"\x47\x01\x00\x1f" + bytes(184)) is None or n <= 64
    assert transport_stream.demux(b"x" * 188) is None


def packet(pid, counter, body, start=False, field=None):
    """A transport packet; ``field`` is the adaptation field's content, filled up as needed."""
    room = 184 - len(body)
    if room or field is not None:
        own = field or b""
        own = bytes([max(room - 1, 0)]) + own + (b"\0" if room > 1 and not own else b"") + b"\xff" * (room - 1 - max(len(own), 1))
        body = own[:room] + body
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if room else 0x10) | counter & 15]) + body


def test_streams_of_other_writers():
    """Several programs, tables over two packets, packets sent twice or without payload, units without a length or a timestamp, a stated jump of the counter."""
    T = transport_stream
    programs = b"\0\0\xe0\x10" + b"".join(bytes([0, k, 0xE0 | 0x02, k]) for k in range(1, 60))  # the network's, then 59 programs
    section = bytes([0, 0xB0 | (len(programs) + 9) >> 8, (len(programs) + 9) & 255, 0, 1, 0xC1, 0, 0]) + programs
    section += T.crc32_mpeg(section).to_bytes(4, "big")
    table = [packet(0, 0, b"\0" + section[:183], start=True), packet(0, 1, section[183:])]
    pmt = T.table_packet(0x201, 2, bytes([0xE1, 0x50, 0xF0, 2, 9, 9, 0x1B, 0xE1, 0x50, 0xF0, 0]))
    unit = lambda data, pts, length=True: b"\0\0\1\xe0" + ((len(data) + 3 + 5 * (pts is not None)) * length).to_bytes(2, "big") + (b"\x80\x00\x00" if pts is None else b"\x80\x80\x05" + T.timestamp(pts)) + data
    one, two, three = unit(b"a" * 300, 7777, False), unit(b"b" * 100, None), unit(b"c" * 50, 9999)
    own = [packet(0x150, 3, one[:184], start=True), packet(0x150, 4, one[184:])]
    own += [own[-1], packet(0x150, 4, b"").replace(b"\x34", b"\x24", 1)]  # sent twice; without payload
    own += [packet(0x150, 5, two, start=True, field=b"\x40"), packet(0x1FFF, 0, b"x" * 184), packet(0x150, 12, three, start=True, field=b"\x80")]
    stream = b"".join([*table, pmt, *own])
    assert len(stream) % 188 == 0
    got = T.demux(stream)
    assert got["payload"] == b"a" * 300 + b"b" * 100 + b"c" * 50 and got["pts"] == [7777, None, 9999] and got["random_access"] == [300]
    assert T.demux(b"".join([*table, pmt, *own[:2], *own[4:5][::-1], packet(0x150, 12, three, start=True)])) is None  # a jump that isn't stated


def test_damaged_streams_never_raise():
    r, T = random.Random(9), transport_stream
    base = T.mux(T.padded(bytes(i * 31 % 251 for i in range(1500))))
    for _ in range(20_000):
        bad = bytearray(base)
        for _ in range(r.randint(1, 4)):
            bad[r.choice([r.randrange(len(bad)), 188 * r.randrange(len(bad) // 188) + r.randrange(16)])] = r.randrange(256)
        if r.random() < 0.2:
            del bad[188 * r.randrange(len(bad) // 188) :][:188]
        if r.random() < 0.1:
            bad = bad[: r.randrange(len(bad))]
        T.demux(bytes(bad))


def test_stream_digests(spark):
    import zlib

    T, texts = transport_stream, ["", None, "é" * 40, "x" * 64, "y" * 40_000, "é" * 40]
    rows = T.stream_features(T.write_streams(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)
        media = T.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, len(r.pts)) == (len(media), hashlib.sha256(media).hexdigest(), -(-len(payload) // T.UNIT)) and f"packets={len(media) // 188};" in r.feature
    damaged = T.stream_features(spark.createDataFrame([(1, None), (2, b""), (3, b"x" * 188)], "doc_id long, media binary")).collect()
    assert [(r.payload_bytes, r.media_bytes, r.feature) for r in damaged] == [(None, None, "damaged"), (None, 0, "damaged"), (None, 188, "damaged")]


def test_language_held_out(spark, documents):
    p = language.op5(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    assert p.where("lang_pred = lang").count() > 0.97 * p.count()


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 12, 40])
def test_codewords_are_apart(n):
    words = language.codewords(n)
    apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
    assert len(words) == n and all(set(w) <= {-1, 1} and abs(w.sum()) < n for w in words.T)
    assert not apart or min(apart) >= max(1, words.shape[1] // 5)


def test_many_languages_by_codewords(spark):
    """Twelve made-up languages, by hashed trigrams and random codewords; decoding against plain loops; texts of two languages in equal parts are ambiguous."""
    import math

    r = random.Random(12)
    vocabulary = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(40)] for k in range(12)}
    text = lambda lang, n=30: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(sorted(vocabulary) * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    got = language.predict(df.withColumn("held", language.held_out(F.col("doc_id"))), model).where("held").collect()
    assert len(got) > 20 and sum(x.lang_pred == x.lang for x in got) >= 0.97 * len(got)
    mixed = [text(a, 15) + " " + text(b, 15) for a, b in (r.sample(sorted(vocabulary), 2) for _ in range(40))]
    assert sum(x.ambiguous for x in got) <= 0.03 * len(got)
    flags = [x.ambiguous for x in language.predict(spark.createDataFrame([(t,) for t in mixed], "text string"), model).collect()]
    assert sum(flags) > 0.9 * len(flags)
    margins, root = model.margins(pa.array(mixed))
    best, score, _ = model.decode(margins, root)
    for m, b, s in zip(margins, best, score):
        losses = [sum(w * math.log1p(math.exp(-c * x)) if -c * x < 500 else w * -c * x for w, c, x in zip(model.trust, word, m)) for word in model.words]
        shares = [math.exp(min(losses) - x) for x in losses]
        assert b == losses.index(min(losses)) and abs(s - max(shares) / sum(shares)) < 1e-9


@pytest.mark.parametrize("whole", [near_dedup.WHOLE, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, whole):
    monkeypatch.setattr(near_dedup, "WHOLE", whole)  # 3: most buckets go by hubs and the rest that these leave
    r = random.Random(2)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(120)] for _ in range(20)]
    docs = []
    for b in base:
        docs.append(b)
        for _ in range(6):
            c = list(b)
            for _ in range(r.randint(0, 6)):
                c[r.randrange(len(c))] = f"n{r.randint(0, 10**9)}"
            docs.append(c)
    for b in base[:5]:  # chains: only neighbours are near-duplicates
        c = list(b)
        for _ in range(15):
            c = list(c)
            for at in r.sample(range(0, 60, 5), 2):
                c[at] = f"n{r.randint(0, 10**9)}"
            docs.append(c)
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"))
    assert {x.doc_id: x.class_id for x in got.collect()} == dict(enumerate(root))


def test_forest_spans_likely_pairs():
    import numpy as np

    r = np.random.RandomState(3)
    for _ in range(30):
        n, registers = int(r.randint(2, 30)), near_dedup.BANDS * near_dedup.ROWS
        base = r.randint(0, 255, (4, registers))
        marks = np.stack([np.stack([np.where(r.rand(registers) < r.choice([0.05, 0.2, 0.3]), r.randint(0, 255, registers), base[r.randint(4)])] * 2) for _ in range(n)]).astype(np.uint8)
        ids = [hashlib.md5(bytes([i])).digest() for i in range(n)]
        likely = [(i, j) for i in range(n) for j in range(i) if (marks[i, 0] == marks[j, 0]).mean() >= near_dedup.LIKELY]
        pairs = near_dedup.forest(ids, marks)
        assert {tuple(sorted(p, reverse=True)) for p in pairs} <= set(likely) and len(pairs) < n

        def classes(links):
            root = list(range(n))
            for a, b in links:
                root = [root[a] if x == root[b] else x for x in root]
            return [root.index(x) for x in root]

        assert classes(pairs) == classes(likely)


def test_decontamination_recall(documents, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    tables = decontamination.Tables([(b.item_id, b.text) for b in bench])
    r, words = random.Random(3), [w for d in documents.limit(50).collect() for w in d.text.split()]
    found = wanted = 0
    for b in bench:
        noisy = [r.choice(words) if r.random() < 0.08 else w for w in b.text.split()]
        text = " ".join([*r.choices(words, k=40), *noisy, *r.choices(words, k=40)])
        if decontamination.best_match(decontamination.plain(b.text), decontamination.plain(text), int(decontamination.RATIO * len(decontamination.plain(b.text)))):
            wanted += 1
            found += any(x[1] == b.item_id for x in tables.search(pa.array([text])))
    assert found >= 0.95 * wanted > 10
    exact = decontamination.contaminated(spark.createDataFrame([(b.item_id, "x " + b.text + " y") for b in bench], "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {b.item_id for b in bench} <= {x.doc_id for x in exact.where("doc_id = item_id and distance = 0").collect()}


def test_html_containers_are_evidence(spark):
    cards = "".join(f"<article><p>Teaser {i}</p></article>" for i in range(3))
    own, letter = "The main text of this page, longer than all of its cards, is number", "Join the letter that every page of this host has"
    pages = [(i, f"http://cards.example/{i}", f"<div><p>{own} {i}</p></div>{cards}") for i in range(4)]
    pages += [(10 + i, f"http://letter.example/{i}", f"<article><p>{own} {i}</p><p>It has a second line, {i}</p><p>{letter}</p></article><p>x</p>") for i in range(5)]
    pages += [(20 + i, f"http://copies.example/{i}", f"<article><p>{own}</p><p>And more</p></article>") for i in range(5)]
    pages += [(30 + i, f"http://quotes.example/{i}", f"<article><p>{own} {i}</p>{'<p>A quoted line</p>' if i in (1, 2) else ''}</article>") for i in range(4)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{own} {i}" for i in range(4))
    assert all(got[10 + i] == f"{own} {i}\n\nIt has a second line, {i}" for i in range(5))
    assert all(got[20 + i] == f"{own}\n\nAnd more" for i in range(5))
    assert all(got[30 + i] == f"{own} {i}" + ("\n\nA quoted line" if i in (1, 2) else "") for i in range(4))


def test_html_names_inside_containers():
    kept = '<h2 id="related-work">A</h2><section id="comments-on-the-draft"><p>B</p></section><p class="notice">C</p><h2 id="social-policy">D</h2><h2 id="comments">E</h2>'
    gone = '<div class="share-buttons">1</div><div class="x related-posts">2</div><section id="comments"><p>3</p></section><div class="cookie-notice">4</div><div id="ad-slot"><p>5</p></div>'
    assert html_text.lines_of(f"<article>{kept}{gone}</article>") == (["A", "B", "C", "D", "E"], True)


@pytest.mark.parametrize("line, times", [(18, 50), (20, 10)])
def test_near_duplicates_by_plain_runs_of_repeated_lines(spark, line, times):
    rows = []
    for k in range(20):
        base, more = (" ".join(f"{p}{k}x{i}" for i in range(n)) for p, n in (("b", 120), ("l", line)))
        rows += [(2 * k, base), (2 * k + 1, base + f" {more}" * times)]
    assert all(near_dedup.similarity(*near_dedup.run_sets(pa.array([a[1], b[1]]))) > 0.82 for a, b in zip(rows[::2], rows[1::2]))
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(20)) >= 18


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.14])
def test_decontamination_recall_of_character_edits(documents, spark, rate):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    tables = decontamination.Tables([(b.item_id, b.text) for b in bench])
    r, words = random.Random(5), [w for d in documents.limit(50).collect() for w in d.text.split()]
    found = wanted = 0
    for b in bench:
        at = set(r.sample(range(len(b.text)), int(rate * len(b.text))))
        typed = "".join(r.choice(["", "q", "q" + c]) if i in at else c for i, c in enumerate(b.text))
        before, after = (" ".join(r.choices(words, k=40)) for _ in range(2))
        text, pattern = f"{before} {typed} {after}", decontamination.plain(b.text)
        if decontamination.best_match(pattern, decontamination.plain(text), int(decontamination.RATIO * len(pattern))):
            wanted += 1
            got = [x for x in tables.search(pa.array([text])) if x[1] == b.item_id]
            found += len(got) == 1 and abs(got[0][2] - len(before.lower().encode()) - 1) < 0.15 * len(b.text)
    assert found >= 0.9 * wanted > 0.8 * len(bench)


def test_decontamination_gives_each_passage_its_span():
    item = "Seven grey herons, it is said, wait by the old mill until rain falls."
    text = f"Ümlaut\n{item}\n\n{item.replace(' ', '  ')} And more. {item.replace('herons', 'hxrons')}"
    got = decontamination.Tables([(7, item)]).search(pa.array([None, text]))
    data = text.lower().encode()
    assert [(g[0], g[1], g[4], decontamination.plain(data[g[2] : g[3]].decode())) for g in got] == [(1, 7, k, item.lower().replace("herons", h)) for k, h in ((0, "herons"), (0, "herons"), (1, "hxrons"))]


def test_decontamination_against_all_windows():
    """Every passage that a scan of all windows by exact distance has, and no others; with all kinds of edits, repeats, and items in one block or several."""
    r, letters = random.Random(11), "abcdefghijklmnop"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(6, 25)))) for i in range(12)]
    texts = []
    for i, item in items * 4:
        chars = list(item)
        for _ in range(r.randint(0, int(0.13 * len(item)))):
            at = r.randrange(len(chars))
            chars[at : at + 1] = r.choice([[], [r.choice(letters)], [chars[at], r.choice(letters + " ")]])
        noisy = "".join(chars)
        texts.append(" ".join([*(word() for _ in range(20)), noisy, *(word() for _ in range(r.randint(0, 9))), *([item] if r.random() < 0.3 else []), word()]))
    texts.append("")
    got = decontamination.Tables(items).search(pa.array(texts))
    want = {}
    for row, text in enumerate(texts):
        for k, item in items:
            if found := decontamination.passages(item, text, int(decontamination.RATIO * len(item))):
                want[row, k] = len(found)
    have = {}
    for row, k, start, end, distance in got:
        pattern = dict(items)[k]
        assert decontamination.best_match(pattern, texts[row][start:end], len(pattern)) == (distance, end - start) or distance <= decontamination.RATIO * len(pattern)
        have[row, k] = have.get((row, k), 0) + 1
    assert have.keys() <= want.keys() and sum(have.values()) >= 0.95 * sum(want.values()) > 45
    parts = [x for some in (items[:5], items[5:]) for x in decontamination.Tables(some).search(pa.array(texts))]
    assert sorted(parts) == sorted(got)


def test_contaminated_odd_rows(spark):
    schema, none = "item_id long, text string", spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "..."), (4, "one two three four five six seven eight nine ten")], schema)
    docs = spark.createDataFrame([*ODD, (7, "x one two three four five six seven eight nine ten", "en", "s", 1, None, None, None)], SCHEMA)
    assert sorted((x.doc_id, x.item_id, x.distance) for x in decontamination.contaminated(docs, items).collect()) == [(7, 1, 0), (7, 4, 0)]
    assert decontamination.contaminated(docs.limit(0), items).collect() == [] and decontamination.contaminated(docs, none).collect() == []
    assert decontamination.clean_of(docs, none).count() == len(ODD) + 1 and decontamination.clean_of(docs, items).count() == len(ODD)


def test_decontamination_finds_unchanged_short_items():
    r = random.Random(7)
    words = [f"w{i}x" for i in range(300)]
    items = [(i, " ".join(r.choices(words, k=1 + i % 3))) for i in range(300)]
    tables = decontamination.Tables(items)
    for i, item in items:
        text = " ".join([*r.choices(words, k=20), item, *r.choices(words, k=20)])
        assert any(x[1] == i and x[4] == 0 for x in tables.search(pa.array([text]))), item
    assert [x[1] for x in decontamination.Tables([(1, "a b")]).search(pa.array(["a\u00a0b", "ab"]))] == [1]


def test_html(spark):
    page = "<html><body><nav><p>Menu</p></nav><article><h1>T&amp;x</h1><p>One <b>two</b><br>three<p>Four<div class='share'>no</div></article><footer>f</footer>"
    assert html_text.lines_of(page) == (["T&x", "One two three", "Four"], True)
    site = [(i, f"http://h.example/a/{i}", f"<p>Site name</p><p>Own text {i}</p><p>Imprint</p>") for i in range(4)]
    rows = html_text.main_text(spark.createDataFrame([*site, (9, None, None), (10, "http://o.example/", "<p>Alone</p>")], "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in rows.collect()} == {**{i: f"Own text {i}" for i in range(4)}, 9: "", 10: "Alone"}
    r = random.Random(4)
    for _ in range(100):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(html_text.shared_lines(a, b)) == best[-1][-1]


def test_html_against_brute_force(spark):
    """Pages of three hosts, with and without main parts, against neighbours found by sorting all pages in one list."""
    from urllib.parse import urlsplit

    r = random.Random(8)
    pages = []
    for i in range(150):
        host = r.choice(["a.example", "b.example", "b.example", "c.example"])
        lines = [f"<p>{host} line {r.randrange(6)}</p>" for _ in range(r.randrange(5))] + [f"<p>A longer line of page {i}, number {k}</p>" for k in range(r.randrange(4))]
        r.shuffle(lines)
        body = "".join(lines)
        pages.append((i, f"http://{host}/{r.randrange(40)}/{i}", f"<nav>Menu</nav><article>{body}</article>" if r.random() < 0.5 else f"<div>{body}</div><footer>f</footer>"))
    df = spark.createDataFrame([*pages, *pages[:3]], "page_id long, url string, html string")
    got = html_text.main_text(df).collect()
    assert len(got) == 153
    order = sorted(pages, key=lambda p: (urlsplit(p[1]).netloc, urlsplit(p[1]).path))
    parsed = [html_text.lines_of(p[2]) for p in order]
    want = {}
    for at, ((i, url, _), (lines, has_main)) in enumerate(zip(order, parsed)):
        near = [parsed[k][0] if 0 <= k < len(order) and urlsplit(order[k][1]).netloc == urlsplit(url).netloc else None for k in (at - 1, at + 1, at - 2, at + 2)]
        cut = html_text.site_lines(lines, [len(t) for t in lines], has_main, near)
        want[i] = "\n\n".join(t for k, t in enumerate(lines) if k not in cut)
    assert {x.page_id: x.text for x in got} == want and any(len(want[i]) < len("\n\n".join(p[0])) for (i, *_), p in zip(order, parsed))
    assert all(x.n_chars == len(x.text) for x in got)


def test_html_of_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, key string, host string, shared string"
    long = "<p>" + "word " * 60_000 + "</p>"
    rows = [(1, None, "<p>A</p>", "t", "k", "h", "s"), (2, "http://x/", "", None, None, None, None), (None, "not a url", "<p>B", None, None, None, None), (3, "http://y/1", long, "t", None, None, None), (3, "http://y/1", long, "t", None, None, None), (4, "http://z/", "<<<>&&#;<p", None, None, None, None)]
    got = html_text.main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(x.text is not None for x in got)
    assert [x.n_chars for x in got if x.page_id == 3] == [299_999] * 2
    text = {x.page_id: x.text for x in got}
    assert (text[1], text[2], text[None]) == ("A", "", "B")
    assert html_text.main_text(spark.createDataFrame([], schema)).collect() == []


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"].replace("any person", "every person")
    rows = licenses.find_licenses(spark.createDataFrame([(1, "x y z " + mit + " q"), (2, "Nothing here."), (3, None), (4, "Released under the MIT License.")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in rows} == {(1, "MIT"), (4, "MIT-notice")}
    assert all(r.coverage > 0.9 for r in rows)


def test_licenses_close_together():
    index = licenses.Index(licenses.TEMPLATES)
    one = "Copyright 2019 A. All rights reserved. "
    for text, name, n in ((one * 2, "all-rights-reserved", 2), ("All rights reserved. " * 300, "all-rights-reserved", 300), (f"{licenses.TEMPLATES['MIT']} " * 3, "MIT", 3)):
        rows = sorted((r for r in index.scan(pa.array([text])) if r[1] == name), key=lambda r: r[3])
        assert len(rows) == n and all(r[2] == 1 for r in rows)
        spans = {" ".join(re.findall(r"\w+", text[r[3] : r[4]].lower())) for r in rows}
        assert spans == {" ".join(re.findall(r"\w+", licenses.TEMPLATES[name].lower()))}


def common(a, b):
    """The length of a longest common subsequence, by all cells."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("times", [1, 2, 100])
def test_licenses_against_exhaustive_alignment(times):
    r = random.Random(times)
    template = [f"t{r.randrange(10**6)}" for _ in range(40)]
    index = licenses.Index({"own": " ".join(template)})
    planted = []
    for _ in range(times):
        notice = list(template)
        for at in r.sample(range(1, 39), 2):
            notice[at] = f"x{r.randrange(10**6)}"
        planted.append(notice)
    text = ["begin"] + [w for n in planted for w in [*n, *[f"f{r.randrange(10**6)}" for _ in range(r.randrange(4))]]]
    rows = sorted(index.scan(pa.array([" ".join(text)])), key=lambda x: x[3])
    assert len(rows) == times
    for row, notice in zip(rows, planted):
        words = " ".join(text)[row[3] : row[4]].split()
        assert row[2] == common(template, words) / 40 == common(template, notice) / 40 and words == notice


def test_license_families():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        rows = index.scan(pa.array([f"Some words before. {text} Some words after."]))
        assert [(x[1], x[2]) for x in rows] == [(name, 1.0)]
    both = index.scan(pa.array([f"{licenses.TEMPLATES['MIT']} {licenses.TEMPLATES['ISC']}"]))
    assert [x[1] for x in both] == ["MIT", "ISC"]


def test_license_overlaps_against_all_pairs():
    r = random.Random(9)
    for _ in range(200):
        found = []
        for _ in range(r.randrange(12)):
            a = r.randrange(60)
            n = r.randint(1, 20)
            found.append((n, r.choice([0.8, 0.9, 1.0]), a, a + n + r.randrange(3)))
        kept = []
        for i in sorted(range(len(found)), key=lambda i: (-found[i][0], -found[i][1], i)):
            if all(2 * (min(found[i][3], found[j][3]) - max(found[i][2], found[j][2])) < found[i][3] - found[i][2] for j in kept):
                kept.append(i)
        assert licenses.strongest(found) == sorted(kept)


def test_licenses_of_odd_rows(spark):
    odd = spark.createDataFrame([*ODD, (6, "All rights reserved.", None, None, None, None, None, None), (6, "All rights reserved.", None, None, None, None, None, None)], SCHEMA)
    assert [(x.doc_id, x.license) for x in licenses.find_licenses(odd).collect()] == [(6, "all-rights-reserved")] * 2
    assert licenses.find_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = licenses.find_licenses(odd.withColumnRenamed("doc_id", "license"), key="license")
    assert clash.columns[:2] == ["key", "license"] and clash.select("key").distinct().collect()[0][0] == 6
    assert licenses.find_licenses(odd, templates={"none": "?!"}).collect() == []


def test_short_licenses_with_one_word_changed():
    r = random.Random(2)
    for size in (8, 9, 11, 12, 16):
        for t in range(20):
            words = [f"t{r.randrange(10**6)}" for _ in range(size)]
            index, k = licenses.Index({"own": " ".join(words)}), r.randrange(size)
            text = " ".join(["some", "words", "before", *words[:k], "changed", *words[k + 1 :], "and", "after"])
            assert len(index.scan(pa.array([text]))) == 1, (words, k)


def test_digest_of_no_spans(spark):
    row = pii.pii_digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest() and row.spans == "" and row.n_email == 0


def test_filter_loses_no_row(spark):
    from pyspark.sql import functions as F

    from quillmatch.llm.rows import maybe_among

    rows = spark.range(5000).select((F.col("id") * 7919).alias("x"), (F.col("id") % 5 == 0).alias("among"))
    wanted = rows.where("among").select("x")
    marked = maybe_among(rows, F.col("x"), wanted)
    assert marked.where("among and not __maybe").count() == 0
    assert marked.where("not among and __maybe").count() < 100
    assert maybe_among(rows, F.col("x"), wanted.where("x < 0")).where("__maybe").count() == 0
