"""Each operator against a plain version of its contract, over whole tables and over odd rows."""

import base64
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_template, hilbert, licenses, packing, quality, queries, secrets, simhash, telephony, viterbi, warc

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n\t", "a", "one two three", "Straße ÄÖ ſecret Kelvin İ", "😀 emoji \u2028 x", "the cat the cat the cat the cat the cat",
    "a a a a a a a", "MIT License, mit LICENSE mit license", "GNU General Public License v2 or Apache License, Version 2.0. Apache license",
    "token = abcdefgh password: 'x' secret=12345678 AKIAABCDEFGHIJKL AKIAABC deadbeefdeadbeefdeadbeefdeadbeef", "x\ny\nx\n \nx\r\ny",
    "key Zx9Qw3Er7Ty1Ui5Op2As8Df and 123e4567-e89b-12d3-a456-426614174000 some_snake_case_identifier_name", "<|im_end|>\\<|\\\\n", "<|endoftext|> a<|endoftext|>b",
    "word " * 3000, " ".join(f"w{i % 977}x" for i in range(20000)), "the cat " * 30 + "<b> $5 #1 | & %", "license", "general public license general public license", "q" * 5000, "é" * 97 + " " + "▁x y",
]


def odd(spark):
    """Odd texts, twice, with nulls elsewhere and columns named as operators name theirs."""
    rows = [(i // 2 if i != 3 else None, t, ("en", None, "xx", "fr")[i % 4], (None, "src0")[i % 2], i if i % 3 else None, i, i, str(i), i) for i, t in enumerate(x for t in ODD for x in (t, t))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _q int, _fp int, _spans string, rank int").repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def at(tmp_path, spark, docs):
    """Runs a query over the odd rows as documents."""
    odd(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def none(df):
    return df.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- quality -----------------------------------------------------------------------------------------------------


def plain_base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(spark, docs, at):
    for folder in (SF, at):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        out = queries.op1_distribution_divergence(spark, folder).collect()
        found = Counter((r[0], r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
        assert found == Counter((r.doc_id, *plain_base(r.text)) for r in texts)
        assert not any(r.kept and r.base_failed for r in out)


def test_quality_distances(spark):
    import numpy as np

    lorem = "The werewolves and the dog, werewolves in of 12, "
    rows = [(i, "en", lorem * (20 + i)) for i in range(8)] + [(8, "en", "#### $$$$ " * 200), (9, "en", "few words")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = {r.doc_id: r["_q"] for r in quality.quality_rules(df, n_common=4).collect()}
    classes = [lambda c: "a" <= c <= "z", lambda c: c in " \t\n\x0b\x0c\r", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in "#*$%&|<>", lambda c: 32 < ord(c) < 127]
    kind = lambda c: next((i for i, f in enumerate(classes) if f(c)), 6)
    count = lambda t: np.bincount([kind(c) for c in t], minlength=7)
    whole = sum(count(t) for *_, t in rows)
    every = Counter(w for *_, t in rows for w in words(t))
    common = sorted(every, key=lambda w: (-every[w], w))[:4]

    def share(times):
        n = sum(times.values())
        p = [times[w] / n for w in common]
        return np.array([*p, 1 - sum(p)])

    def js(p, q):
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    for i, _, t in rows:
        n = len(words(t))
        assert out[i].class_distance == (None if n < 50 else pytest.approx(js(count(t) / len(t), whole / whole.sum()), abs=1e-9))
        assert out[i].word_distance == (None if n < 100 else pytest.approx(js(share(Counter(words(t))), share(every)), abs=1e-7))
    clash = quality.quality_rules(odd(spark))
    assert clash.count() == 2 * len(ODD) and clash.columns.count("_q") == 1
    assert quality.quality_rules(none(odd(spark))).collect() == []


# ---- sharding ----------------------------------------------------------------------------------------------------


def hilbert_points(bits, dims):
    """All cells by index, from the recursive definition by Skilling's inverse (transpose to axes)."""
    out = []
    for index in range(1 << bits * dims):
        x = [0] * dims
        for k in range(bits * dims):
            if index >> (bits * dims - 1 - k) & 1:
                x[k % dims] |= 1 << (bits - 1 - k // dims)
        t = x[-1] >> 1
        for i in range(dims - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= t
        q = 2
        while q != 1 << bits:
            for i in range(dims - 1, -1, -1):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
            q <<= 1
        out.append(tuple(x))
    return out


@pytest.mark.parametrize(("bits", "dims"), [(3, 2), (2, 3), (1, 3)])
def test_hilbert_curve(spark, bits, dims):
    points = hilbert_points(bits, dims)
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(points))
    df = spark.createDataFrame(points, [f"x{i}" for i in range(dims)])
    got = df.select(*df.columns, hilbert.curve_index([F.col(c) for c in df.columns], bits).alias("i")).collect()
    assert [tuple(r)[:-1] for r in sorted(got, key=lambda r: r.i)] == points
    assert sorted(r.i for r in got) == list(range(len(points)))


def test_hilbert_shards(spark, at):
    for folder in (SF, at):
        texts = spark.read.parquet(f"{folder}/documents.parquet").collect()
        out = queries.op2_hilbert_shards(spark, folder).collect()
        raw = [(r.doc_id, (r.text or "").encode()) for r in texts]
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in raw)
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[k]) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        along = [r.curve_index for r in sorted(out, key=lambda r: (r.shard, r.slot))]
        assert along == sorted(along)
    assert hilbert.hilbert_shards(none(odd(spark)), ["lang", "n_chars"]).collect() == []
    same = spark.range(1000).selectExpr("7L AS doc_id", "'x' AS lang", "1 AS rank", "3 AS _curve")
    out = hilbert.hilbert_shards(same, ["lang"], 7).collect()
    assert len({(r["_shard"], r["_slot"]) for r in out}) == 1000 and len({r["_shard"] for r in out}) == 7


# ---- telephony ---------------------------------------------------------------------------------------------------


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for b in block[4:]:
        for nibble in (b & 15, b >> 4):
            step = int(telephony.STEPS[index])
            change = step >> 3
            if nibble & 4:
                change += step
            if nibble & 2:
                change += step >> 1
            if nibble & 1:
                change += step >> 2
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(value)
    return out


def test_telephony_codecs():
    noise = np.random.default_rng(1).integers(0, 256, 192 * 5, dtype=np.uint8)
    assert telephony.decode_adpcm(noise).tolist() == [plain_adpcm(noise[i : i + 192].tobytes()) for i in range(0, len(noise), 192)]
    # Known corners of G.711.
    assert [int(telephony.TABLES[telephony.MULAW][x]) for x in (0x00, 0x7F, 0x80, 0xFF, 0xF0)] == [-32124, 0, 32124, 0, 120]
    assert [int(telephony.TABLES[telephony.ALAW][x]) for x in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    for table in telephony.TABLES.values():  # each sample but the doubled zero stands once, and signs mirror
        assert sorted(table.tolist()) == sorted((-table).tolist())
    for kind in (telephony.MULAW, telephony.ALAW, telephony.ADPCM, telephony.PCM):
        assert telephony.read_wave(telephony.wave(noise.tobytes(), kind))[::2] == (kind, noise.tobytes())
    with pytest.raises(ValueError, match="RIFF"):
        telephony.read_wave(b"nothing")
    assert telephony.resample_double(np.array([0, 4, -3], dtype=np.int16)).tolist() == [0, 2, 4, 0, -3, -3]


def test_telephony_query(spark, at):
    for folder in (SF, at):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        out = queries.op3_telephony(spark, folder).collect()
        want = Counter()
        for r in texts:
            raw = (r.text or "").encode()
            payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
            media = telephony.wave(payload, telephony.MULAW)
            want[(r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())] += 1
        assert Counter(tuple(r)[:7] for r in out) == want
        assert len({(r.payload_sha256, r.feature) for r in out}) == len({r.payload_sha256 for r in out})
    made = telephony.store_telephony(odd(spark).withColumn("_media", F.lit(1)).withColumn("_payload", F.lit(1)), kind=telephony.ADPCM)
    assert telephony.read_telephony(made).count() == 2 * len(ODD)
    assert telephony.read_telephony(telephony.store_telephony(none(odd(spark)))).collect() == []


# ---- chat --------------------------------------------------------------------------------------------------------


def plain_chat(rows):
    out = {}
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        own = [(r[2] or "", r[3] or "") for r in own]
        turns = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        size = sum(len(f"<|im_start|>{chat_template.escape_line(r)}\n{chat_template.escape(t)}<|im_end|>\n") for r, t in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def test_chat_query(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.PROBE
    assert {r[0]: tuple(r)[1:] for r in queries.op4_template_compiler(spark, SF).collect()} == plain_chat(rows)
    strange = [(c, k % 3 or None, r, t) for c in (None, 1, 2) for k, (r, t) in enumerate([("user", None), (None, "x"), ("assistant", "\\"), ("assistant", "\\<|im_end|>\n<|"), ("a\nb<|im_start|>", "<|im_start|>a\n"), ("assistant", ""), ("assistant", "<" * 50 + "|" * 50), ("assistant", "\\n\\\\")])] * 2
    df = spark.createDataFrame(strange, "conv_id long, turn long, role string, text string").withColumn("_segment", F.lit(1))
    for segment in (1 << 20, 7, 1):
        got = chat_template.read_conversations(chat_template.format_conversations(df, segment=segment)).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == plain_chat(strange)
    assert chat_template.read_conversations(chat_template.format_conversations(none(df))).collect() == []


def test_templates():
    render = chat_template.render
    assert render("a{{ 1 + 2 * 3 }}{# c #}{% if x == 'y' and not none %}Y{% elif x %}{{ x | upper }}{% else %}N{% endif %}", x="q") == ("a7Q", [])
    assert render("{% for m in ms %}{{ loop.index }}{% generation %}{{ m.t }}{% endgeneration %};{% endfor %}", ms=[{"t": "ab"}, {"t": ""}, {"t": "c"}]) == ("1ab;2;3c;", [(1, 3), (7, 8)])
    assert render("{% set n = 'v' ~ 1 %} {{- n if n in ('v1') else 'no' }}") == ("v1", [])
    assert chat_template.fold(chat_template.parse("a{% if 1 < 2 %}b{{ 'c' ~ 3 }}{% else %}{{ x }}{% endif %}{% if false or x %}d{% endif %}"))[0] == ("text", "abc3")
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{{ ''.join }}", "{% for %}", "{% if x %}", "{{ x", "{{ x | nothing }}", "{% import os %}"):
        with pytest.raises(chat_template.TemplateError):
            render(bad, x="s")
    for text in ("\\", "<|", "<\\|", "\\\\<|<|\\n", "\n"):
        assert chat_template.unescape(chat_template.escape(text)) == text == chat_template.unescape(chat_template.escape_line(text))


# ---- streaming Viterbi -------------------------------------------------------------------------------------------


def plain_viterbi(v, text):
    best = [(-math.inf, -1)] * (len(text) + 1)
    best[0] = (0.0, -1)
    for s in range(len(text)):
        single = False
        for e in range(s + 1, min(s + v.longest, len(text)) + 1):
            if found := v.pieces.get(text[s:e]):
                single |= e == s + 1
                if best[s][0] + found[1] > best[e][0]:
                    best[e] = (best[s][0] + found[1], s)
        if not single and best[s][0] + v.unknown_score > best[s + 1][0]:
            best[s + 1] = (best[s][0] + v.unknown_score, s)
    cuts = [len(text)]
    while cuts[-1]:
        cuts.append(best[cuts[-1]][1])
    cuts.reverse()
    return [i for s, e in itertools.pairwise(cuts) for i in ([v.pieces[text[s:e]][0]] if text[s:e] in v.pieces else v.spelled(text[s:e]))]


@pytest.fixture(scope="session")
def encoder():
    return viterbi.Encoder(queries.vocabulary("piece_bpe_32k.model"))


def test_streaming_equals_whole(encoder, docs):
    texts = [t for t in ODD if t and len(t) < 6000] + [r.text for r in docs.limit(40).collect()]
    for text in texts:
        normal = encoder.v.model.normalize(text)
        want = plain_viterbi(encoder.v, normal)
        assert encoder.encode(text) == want
        for step in (1, 5, 1000):
            search = viterbi.StreamingViterbi(encoder.v)
            got = [i for at in range(0, len(normal), step) for i in search.feed(normal[at : at + step])]
            assert got + search.finish() == want
            assert search.commits and (search.widest <= 4 * encoder.v.longest or set(text) == {"q"})  # one letter again and again: the paths of even and odd places never meet


def test_streaming_commits_early(encoder):
    """Ids come while the text still does, the window stays short, and what is committed is let go."""
    text = encoder.v.model.normalize("internationalization of the communications " * 4000)
    search, early = viterbi.StreamingViterbi(encoder.v), 0
    for at in range(0, len(text), 1000):
        early += len(search.feed(text[at : at + 1000]))
        assert len(search.text) < 2 * viterbi.STEP + 2000 and len(search.score) == len(search.text) + 1
    rest = len(search.finish())
    assert early > 50 * rest and search.commits > 1000 and search.widest <= 2 * encoder.v.longest
    small = viterbi.Encoder(queries.vocabulary("piece_bpe_32k.model"))
    small.v.longest = max(map(len, small.v.pieces))
    ids, commits, widest = small.encode_all(["x" * 5000])[0]
    assert np.frombuffer(ids, dtype="<i4").tolist() == plain_viterbi(encoder.v, encoder.v.model.normalize("x" * 5000)) and commits and widest


def test_viterbi_equals_the_library(encoder, tmp_path, docs):
    """The same vocabulary, read as a unigram model by the library itself (short words: it adds scores in 32 bits)."""
    import sentencepiece

    data = open(queries.vocabulary("piece_bpe_32k.model"), "rb").read()

    def varint(at):
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    at, out = 0, b""
    while at < len(data):
        start = at
        tag, at = varint(at)
        size, at = varint(at)
        body, at = data[at : at + size], at + size
        if tag == 0x12:  # trainer_spec: model_type is field 3; the last one given counts
            body += b"\x18\x01"
            n, length = len(body), b""
            while n > 127:
                length += bytes([n & 127 | 128])
                n >>= 7
            out += b"\x12" + length + bytes([n]) + body
        else:
            out += data[start:at]
    unigram = sentencepiece.SentencePieceProcessor(model_proto=out)
    same = total = 0
    for word in sorted({w for r in docs.collect() for w in r.text.split()})[:4000]:
        if re.search("  ", word) or len(word) > 20:
            continue
        total += 1
        same += unigram.encode(word) == encoder.encode(word)
    assert total > 1000 and same == total


def fed(v, text, step=97):
    """Ids, commits and the widest wait of a text that the search is fed bit by bit."""
    search = viterbi.StreamingViterbi(v)
    ids = [i for k in range(0, len(text), step) for i in search.feed(text[k : k + step])]
    ids += search.finish()
    return ids, search.commits, search.widest


def unpacked(found):
    return [(np.frombuffer(ids, dtype="<i4").tolist(), commits, widest) for ids, commits, widest in found]


def test_viterbi_lockstep(docs):
    """Unseen words are searched many at a time, not one by one (before: a search for nearly every one), with the same result."""
    texts = [r.text for r in docs.collect()] + [t or "" for t in ODD if len(t or "") < 6000]
    one = viterbi.Encoder(queries.vocabulary("piece_bpe_32k.model"))
    got = [x for i in range(0, len(texts), 100) for x in unpacked(one.encode_all(texts[i : i + 100]))]
    assert got == [fed(one.v, one.v.model.normalize(t)) for t in texts]
    words = {w for t in texts for w in viterbi.WORDS.findall(one.v.model.normalize(t))}
    assert len(words) > 10_000 and one.searched < len(words) / 50


def test_viterbi_lockstep_of_odd_vocabularies():
    """Equal sums, pieces across words, characters without a piece, and paths that stay apart for long."""
    rng = random.Random(5)
    left_out = taken = 0
    for _ in range(60):
        v = object.__new__(viterbi.Vocabulary)
        made = {"".join(rng.choice("aab▁") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))} - {"▁" * k for k in range(rng.randint(0, 3))}
        made = {p for p in made if rng.random() < 0.3 or "▁" not in p.lstrip("▁")} | {"aa"}
        v.pieces = {p: (i, -float(rng.randint(1, 3))) for i, p in enumerate(sorted(made))}
        v.bytes_ = {b: 100 + b for b in range(rng.choice((0, 256)))}
        v.unknown, v.unknown_score, v.longest = 99, -13.0, max(map(len, made))
        v.table = {p[:k]: () for p in v.pieces for k in range(1, len(p))} | v.pieces
        v.model = SimpleNamespace(normalize=lambda x: x)
        texts = ["".join(rng.choice("aaab▁▁é😀") for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["a" * 90, "▁", "▁▁a▁▁"]
        one = viterbi.Encoder.__new__(viterbi.Encoder)
        one.v, one.known, one.words = v, {}, {}
        one.nodes = one.searched = one.held = 0
        assert unpacked(one.encode_all(texts)) == [fed(v, t, 3) for t in texts]
        words = sorted({w for t in texts for w in viterbi.WORDS.findall(t) if w[-1] != "▁"})
        found = dict(viterbi.search_words(v, words))
        for w, whole in found.items():
            assert unpacked([whole]) == [fed(v, w, 3)]
        taken, left_out = taken + len(found), left_out + len(words) - len(found)
    assert taken > 1000 and left_out > 50


def test_viterbi_query(spark, at, encoder):
    """The ids of the whole query, text by text, are those of a plain search over the whole text at once."""
    for folder in (SF, at):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        out = queries.op5_streaming_viterbi(spark, folder).collect()
        want = {x: plain_viterbi(encoder.v, encoder.v.model.normalize(x or "")) for x in {r.text for r in texts}}
        decoded = lambda x, want=want: hashlib.sha256(encoder.v.model.decode(want[x]).encode()).hexdigest()
        assert Counter((r.doc_id, r.n_ids, tuple(r.ids), r.decoded_sha256) for r in out) == Counter((r.doc_id, len(want[r.text]), tuple(want[r.text]), decoded(r.text)) for r in texts)
        for r in out:
            assert (r.commits > 0) == (r.n_ids > 0) == (r.widest_wait > 0) and r.commits <= max(r.n_ids, 1)
            if folder == SF:
                assert r.decoded_sha256 == hashlib.sha256(next(x.text for x in texts if x.doc_id == r.doc_id).encode()).hexdigest()

    forgetful = viterbi.Encoder(queries.vocabulary("piece_bpe_32k.model"))
    for r in texts:
        forgetful.nodes, forgetful.held = viterbi.NODES + 1, viterbi.REMEMBERED + 1  # all is forgotten with the next search and text
        assert forgetful.encode(r.text or "") == want[r.text] and len(forgetful.known) < 30_000 and not forgetful.words
    # What is looked up is what whole texts give when they are fed: ids, commits and the widest wait; and most ids come before the end.
    early = total = 0
    for r in texts:
        normal, search, ids = encoder.v.model.normalize(r.text or ""), viterbi.StreamingViterbi(encoder.v), []
        for k in range(0, len(normal), 97):
            ids += search.feed(normal[k : k + 97])
        early += len(ids)
        ids += search.finish()
        total += len(ids)
        raw, commits, widest = encoder.encode_all([r.text or ""])[0]
        assert (np.frombuffer(raw, dtype="<i4").tolist(), commits, widest) == (ids, search.commits, search.widest)
    assert early > 0.5 * total
    df = viterbi.decode_ids(viterbi.encode_texts(odd(spark).withColumn("_ids", F.lit(1)), queries.vocabulary("piece_bpe_32k.model")), queries.vocabulary("piece_bpe_32k.model"), to="text")
    assert df.count() == 2 * len(ODD)
    assert viterbi.encode_texts(none(odd(spark)), queries.vocabulary("piece_bpe_32k.model")).collect() == []


# ---- WARC --------------------------------------------------------------------------------------------------------


def test_warc_query(spark, tmp_path):
    odd_pages = [(i, f"http://x/{i}\r\nX: y" if i % 2 else None, t) for i, t in enumerate(["WARC/1.1\r\n\r\n", None, "", "a\r\n\r\nb", "a\r\n\r\nb", "é" * 9, None, "\r\n\r\n"])] + [(None, "u", "a\r\n\r\nb"), (7, "http://x/7", "\r\n\r\n")]
    spark.createDataFrame(odd_pages, "page_id long, url string, html string").withColumn("d", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    for folder in (SF, str(tmp_path)):
        pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()
        first, want = {}, Counter()
        for r in pages:
            raw = (r.html or "").encode()
            if r.page_id is not None:
                first[raw] = min(first.get(raw, r.page_id), r.page_id)
        for r in pages:
            raw = (r.html or "").encode()
            again = r.page_id != first.get(raw)
            want[(r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[raw] if again else None)] += 1
        assert Counter(map(tuple, queries.op6_warc_revisits(spark, folder).collect())) == want
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/none")
    assert warc.resolve_revisits(warc.read_archives(spark, f"{tmp_path}/none").drop("payload")).collect() == []
    warc.write_archives(spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "longer text"), (4, "u", "longer text")], "page_id long, url string, html string"), f"{tmp_path}/least", least=5)
    assert {r.key: r.record_type for r in warc.read_archives(spark, f"{tmp_path}/least").collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# ---- licences ----------------------------------------------------------------------------------------------------


def plain_license(text):
    """Every rule over every text, and every pair of detections compared."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")):
        found += [(i, label) for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
    kept = kept_spans([(m.start(), m.end(), r.priority, i, r.label, r.weight) for i, r in enumerate(licenses.rules()) for m in re.finditer(r.pattern, low, re.ASCII)])
    names = {x for _, x in found}
    score = max([0.6 * bool(names), *(s[5] for s in kept)])
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | {s[4] for s in kept})), score, len(kept)


def kept_spans(spans):
    """The best by class first, of these the longest, of these the first; what overlaps one that is kept goes."""
    left, kept = list(spans), []
    while left:
        best = min(left, key=lambda s: (s[2], s[0] - s[1], s[0], s[3]))
        kept.append(best)
        left = [s for s in left if s[1] <= best[0] or s[0] >= best[1]]
    return sorted(kept)


def sample(tree, rng):
    """A string that a parsed pattern matches: branches, repeats and classes by chance."""
    out = ""
    for op, x in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(x)
        elif name == "ANY":
            out += rng.choice(list("abc, "))
        elif name == "IN":
            picks = [p for p in x if str(p[0]) != "NEGATE"]
            what, value = picks[rng.integers(len(picks))]
            if str(x[0][0]) == "NEGATE":
                out += " "
            else:
                out += chr(value) if str(what) == "LITERAL" else chr(rng.integers(value[0], value[1] + 1)) if str(what) == "RANGE" else rng.choice([" ", "\n", "\t"])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, body = x
            for _ in range(int(rng.integers(lo, min(int(hi), lo + 3) + 1))):
                out += sample(body, rng)
        elif name == "SUBPATTERN":
            out += sample(x[-1], rng)
        elif name == "BRANCH":
            out += sample(x[1][rng.integers(len(x[1]))], rng)
        elif name not in ("AT", "ASSERT_NOT"):
            raise AssertionError(name)
    return out


def test_license_rules_lose_nothing(spark):
    """Texts made from each rule: the rule's keyword and the gate are in them, and the scan finds what no prefilter at all finds."""
    rng, texts = np.random.default_rng(4), []
    for r in licenses.rules():
        for _ in range(6):
            text = sample(re._parser.parse(r.pattern), rng)
            if re.search(r.pattern, text, re.ASCII):
                assert r.keyword in text and any(g in text for g in licenses.GATE), (r, text)
                texts.append(text.upper() if len(texts) % 3 == 0 else text)
    assert len(texts) > 5 * len(licenses.rules())
    texts += [" and ".join(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: [(d.start, d.end, d.label) for d in r["_lic"].detections] for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        low = t.lower()
        want = kept_spans([(m.start(), m.end(), r.priority, k, r.label) for k, r in enumerate(licenses.rules()) for m in re.finditer(r.pattern, low, re.ASCII)])
        assert got[i] == [(s[0], s[1], s[4]) for s in want], t


def test_license_suppression(spark):
    """The best rule stays when a worse one, that another overlaps, covers it; chains and long arrays are cut alike."""
    rng = np.random.default_rng(8)
    sets = [[(0, 20, 3000, "a"), (2, 5, 0, "b"), (18, 30, 1000, "c")], [], [(4, 9, 1, "x")], [(i * 10, i * 10 + 9, 3000 + i, "x") for i in range(1500)], [(i * 2, i * 2 + 3, 2000 + i % 7, "x") for i in range(600)]]
    sets += [[(int(s), int(s + n), int(p), str(p)) for s, n, p in zip(rng.integers(0, 60, 12), rng.integers(1, 15, 12), rng.permutation(5000)[:12], strict=True)] for _ in range(60)]
    rows = spark.createDataFrame([(i, [(*s, 1.0) for s in own]) for i, own in enumerate(sets)], f"i int, s {licenses.SPAN}")
    every = F.array_sort("s")
    out = rows.select("i", F.when(F.size("s") < 2, F.col("s")).otherwise(F.flatten(F.transform(licenses.chains(every), licenses.best_of))).alias("kept")).collect()
    for r in out:
        want = kept_spans([(s, e, p // 1000, p, x) for s, e, p, x in sets[r.i]])
        assert [(k.start, k.end, k.priority) for k in r.kept] == [(s[0], s[1], s[3]) for s in want]
    assert [k.label for k in next(r.kept for r in out if r.i == 0)] == ["b", "c"]


def test_long_license_text(spark):
    """Thousands of matches in one text."""
    text = "The MIT License, and the Apache License 2.0; " * 3000
    (row,) = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).collect()
    assert len(row["_lic"].detections) == 6000 and len(row["_lic"].phrases) == 6000


def test_licenses(spark, at):
    assert 400 < len(licenses.rules()) < 1000 and len(licenses.SIGNATURES) > 140
    for folder in ("/root/testdata/sf0.01", at):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        out = Counter(map(tuple, queries.op7_license_rules(spark, folder).collect()))
        assert out == Counter((r.doc_id, *plain_license(r.text)) for r in texts)
    text = "SPDX-License-Identifier: Apache-2.0\nThis is licensed under the terms of the GNU Lesser General Public License, version 2.1. Creative Commons Attribution-ShareAlike 4.0 International; http://creativecommons.org/licenses/by-nc/3.0 Permission is hereby granted, free of charge, to any person obtaining a copy"
    (row,) = licenses.scan_licenses(spark.createDataFrame([(text, 1)], "text string, _lic int")).collect()
    assert [d.label for d in row["_lic"].detections] == ["apache-2.0", "lgpl-2.1", "cc-by-sa-4.0", "cc-by-nc-3.0", "mit"]
    assert licenses.scan_licenses(none(odd(spark))).collect() == []
    assert licenses.scan_licenses(odd(spark)).count() == 2 * len(ODD)


# ---- SimHash -----------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=4):
    distinct = sorted(set(prints))
    top = {f: f for f in distinct}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            top[root(a)] = root(b)
    return {f: root(f) for f in distinct}


def test_simhash_query(spark, at):
    for folder in ("/root/testdata/sf0.01", at):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        prints = [plain_fingerprint(r.text) for r in texts]
        roots = plain_components(prints)
        least = {}
        for r, f in zip(texts, prints, strict=True):
            if r.doc_id is not None:
                least[roots[f]] = min(r.doc_id, least.get(roots[f], r.doc_id))
        want = Counter((r.doc_id, f"{f:016x}", least.get(roots[f])) for r, f in zip(texts, prints, strict=True))
        assert Counter(map(tuple, queries.op8_simhash_bktree(spark, folder).collect())) == want
    assert simhash.near_duplicates(none(odd(spark))).collect() == []


def test_bk_tree_links():
    rng = np.random.default_rng(3)
    for radius, flips in ((4, 3), (4, 6), (2, 2)):
        values = set()
        for center in rng.integers(0, 1 << 63, 12).tolist():
            for _ in range(40):
                v = center
                for b in rng.integers(0, 64, rng.integers(0, flips + 1)).tolist():
                    v ^= 1 << b
                values.add(v)
        values = sorted(values)
        rng.shuffle(values)
        links = simhash.spanning_links(values, radius)
        assert all((a ^ b).bit_count() <= radius for a, b in links) and len(links) < len(values)
        same = {f: f for f in values}
        top = plain_components(values, radius)

        def root(f, same=same):
            while same[f] != f:
                f = same[f]
            return f

        for a, b in links:
            same[root(a)] = root(b)
        classes = lambda of: {frozenset(g) for g in (lambda d: [d[v].append(k) or d for k, v in of.items()] and d.values())(defaultdict(list))}
        assert classes({f: root(f) for f in values}) == classes(top)


@pytest.mark.parametrize("count", [10, 10**6, 10**9, 10**12])
def test_block_masks(count):
    masks = simhash.block_masks(4, count)
    rng = np.random.default_rng(count % 97)
    for _ in range(500):
        change = 0
        for b in rng.integers(0, 64, 4).tolist():
            change |= 1 << b
        assert any(not change & m for m in masks)


def test_full_shards_link_by_midpoints(spark):
    rng = np.random.default_rng(5)
    for radius in (4, 3):
        values = {int(v) for v in rng.integers(0, 1 << 63, 40)}
        for centre in rng.integers(0, 1 << 63, 3).tolist():
            for _ in range(60):
                value = centre
                for b in rng.choice(64, int(rng.integers(0, 6)), replace=False).tolist():
                    value ^= 1 << b
                values.add(value)
        signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
        distinct = spark.createDataFrame(signed, "_fp long")
        want = defaultdict(set)
        for f, top in plain_components(list(values), radius).items():
            want[top].add(f)
        for full in (2, 20, 1 << 14):
            links = simhash.near_links(distinct, radius, len(values), full=full)
            assert all(((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= radius and r.u > r.v for r in links.collect())
            got = defaultdict(set)
            for r in simhash.components(links).collect():
                got[r.root] |= {r.node & ((1 << 64) - 1), r.root & ((1 << 64) - 1)}
            assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_components(spark):
    chain = [(i + 1, i) for i in range(60)] + [(200, 100), (300, 200), (400, 100)] + [(1000 + i, 999) for i in range(50)]
    want = {i: 0 for i in range(1, 61)} | {200: 100, 300: 100, 400: 100} | {1000 + i: 999 for i in range(50)}
    links = spark.createDataFrame(chain, "u long, v long").repartition(4)
    for most in (simhash.LINKS, 30):
        got = simhash.components(links, most).collect()
        assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert simhash.components(links.limit(0)).count() == 0


def test_contracted(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(max(p)), int(min(p))) for p in rng.integers(-200, 200, (300, 2)) if p[0] != p[1]]
    links = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    want = {r.node: r.root for r in simhash.components(links).collect()}
    for parts, held in ((1, simhash.HELD), (3, simhash.HELD), (3, 5)):
        kept = simhash.contracted(links, parts, held)
        assert all(r.u > r.v for r in kept.collect())
        assert {r.node: r.root for r in simhash.components(kept, 40).collect()} == want


# ---- secrets -----------------------------------------------------------------------------------------------------


def plain_secrets(text):
    text, out = text or "", []
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
    out += [(m.start(), 0, m.end()) for m in assign.finditer(low) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_query(spark, at):
    for folder in ("/root/testdata/sf0.01", at):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        out = queries.op9_token_efficiency(spark, folder).collect()
        want = Counter()
        for r in texts:
            base = plain_secrets(r.text)
            said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
            n = Counter(k for _, k, _ in base)
            want[(r.doc_id, n[0], n[1], n[2], hashlib.sha256(said.encode()).hexdigest())] += 1
        assert Counter(tuple(r)[:5] for r in out) == want
        assert all(sum(x.split(":")[0] != "random" for x in r.spans.split(",") if x) == r.n_assign + r.n_access + r.n_hex for r in out)


def test_token_efficiency(spark):
    encoding = secrets.load_encoding(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())
    kinds = lambda t: [(t[s:e], secrets.KINDS[k]) for s, k, e in secrets.scan(t, encoding)]
    assert kinds("key Zx9Qw3Er7Ty1Ui5Op2As8Df end") == [("Zx9Qw3Er7Ty1Ui5Op2As8Df", "random")]
    assert kinds("123e4567-e89b-12d3-a456-426614174000 some_snake_case_identifier_name someCamelCaseIdentifierName 12345678901234567890123") == []
    assert kinds("D41D8CD98F00B204E9800998ECF8427E") == []
    assert secrets.redacted("ab cd ef", [(0, 0, 5), (3, 1, 4), (6, 2, 8)], "*") == "* *"
    df = secrets.scan_secrets(odd(spark), queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern(), redact=True)
    assert df.count() == 2 * len(ODD) and df.where("text IS NULL AND _redacted IS NOT NULL").count() == 0
    assert secrets.scan_secrets(none(odd(spark)), queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern()).collect() == []


# ---- packing -----------------------------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity):
    """Gap sizes left by best-fit over lengths in decreasing order, one by one."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def test_sweep_is_best_fit():
    rng = np.random.default_rng(5)
    for capacity, top, n in ((100, 100, 300), (100, 30, 500), (64, 3, 400), (2048, 1500, 400), (10, 1, 7)):
        lengths = rng.integers(1, top + 1, n).tolist()
        used, ranks = defaultdict(list), 0
        for x in sorted(packing.sweep(Counter(lengths), capacity)):
            assert x.rank == ranks
            ranks += x.count
            for j in range(x.count):
                used[x.sequence + j // x.each].append((x.offset + j % x.each * x.length, x.length))
        assert ranks == n
        for own in used.values():
            own.sort()
            assert all(a + b == c for (a, b), (c, _) in itertools.pairwise(own)) and own[0][0] == 0
        assert sorted(capacity - sum(b for _, b in own) for own in used.values()) == plain_best_fit(lengths, capacity)


def check_packing(texts, out):
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = Counter()
    for i, text in texts:
        ids = np.array([*read.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in itertools.pairwise(own)) and sum(own[-1]) <= 2048
    return len(places), -(-sum(r.length for r in out) // 2048)


def test_packing_query(spark, docs, at, monkeypatch):
    for folder in ("/root/testdata/sf0.01", at):
        texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        n, least = check_packing(texts, queries.op10_best_fit_packing(spark, folder).collect())
        assert n <= least * 1.02 + 1
    monkeypatch.setattr(packing, "INTERVALS", 3)
    check_packing(texts, queries.op10_best_fit_packing(spark, at).collect())
    pieces = packing.tokenized_pieces(odd(spark).withColumn("_piece", F.lit("x")), queries.vocabulary("word_bpe_49k.json"), keep=["doc_id", "_q"], with_ids=True)
    assert packing.best_fit(none(pieces)).collect() == []
    with pytest.raises(ValueError, match="capacity"):
        packing.best_fit(pieces, capacity=16)


# ---- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in quality.quality_rules(docs).where("_q.kept").select("doc_id").collect()}
    rows = [r for r in docs.collect() if r.doc_id in kept]
    best = plain_survivors(rows)
    encoding = secrets.load_encoding(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())
    texts = [(r.doc_id, secrets.redacted(r.text, secrets.scan(r.text, encoding), "[SECRET]")) for r in rows if r.doc_id in best]
    check_packing(texts, out)
    assert 0 < len(texts) < len(kept) < docs.count()
    once = corpus_pipeline.near_duplicate_stage(spark, odd(spark).select(*docs.columns), folder)
    assert once.count() == once.select("doc_id").distinct().count()
    assert corpus_pipeline.secrets_stage(spark, odd(spark).select(*docs.columns), folder).count() == 2 * len(ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none(docs), folder).collect() == []


def plain_survivors(rows):
    """The smallest id of each group that links of op8 and of all pairs that are alike make."""
    prints = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(prints)
    w = [words((r.text or "").lower()) for r in rows]
    sets = [frozenset(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) for x in w]
    first: dict = {}
    top = [first.setdefault(roots[f], i) for i, f in enumerate(prints)]

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    distinct = {s: i for i, s in reversed(list(enumerate(sets)))}
    for i, s in enumerate(sets):
        for t, j in distinct.items():
            if j <= i and 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 9 * len(s & t) >= 4 * (len(s) + len(t)):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    want: dict = {}
    for i, r in enumerate(rows):
        want[root(i)] = min(r.doc_id, want.get(root(i), r.doc_id))
    return set(want.values())


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words((x or "").lower()) for x in (a, b)))
    return len(a & b) / len(a | b)


def copies(n, words_in, edits, rng):
    """n texts, each with a copy in which some words, dealt evenly, are others."""
    for _ in range(n):
        w = [f"w{x}" for x in rng.integers(0, 5000, words_in)]
        c = list(w)
        for k in range(edits):
            c[(2 * k + 1) * words_in // (2 * edits)] = f"edit{k}"
        yield " ".join(w), " ".join(c)


def test_near_copies(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    near, far = list(copies(30, 200, 4, rng)), list(copies(30, 200, 8, rng))
    assert all(jaccard(a, b) >= 0.8 for a, b in near) and all(jaccard(a, b) < 0.8 for a, b in far)
    assert sum((plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() > 4 for a, b in near) > 20
    far = [p for p in far if (plain_fingerprint(p[0]) ^ plain_fingerprint(p[1])).bit_count() > 4]
    chain = [" ".join(f"c{x}" for x in range(k, k + 100)) for k in range(0, 200, 10)]  # each like the next, not like the first
    assert jaccard(chain[0], chain[1]) > 0.8 > jaccard(chain[0], chain[2])
    texts = [x for p in near + far for x in p] + chain
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    at = 2 * len(near + far)
    assert got == set(range(0, 2 * len(near), 2)) | set(range(2 * len(near), at)) | {at}


def test_near_duplicate_stage(spark):
    """The survivors over a whole table, by links of op8 and of all pairs that are alike."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    want = plain_survivors(rows)
    by_print = set(plain_components([plain_fingerprint(r.text) for r in rows]).values())
    got = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").select("doc_id").collect()]
    assert sorted(got) == sorted(want) and len(got) < len(by_print)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").collect() == []


def family(n, n_words, most, rng):
    """n copies of one text, each with up to `most` of its words changed: some are alike, some are too far from all."""
    base = [f"b{x}" for x in range(n_words)]
    for k in range(n):
        w = list(base)
        for at in rng.choice(n_words, int(rng.integers(0, most + 1)), replace=False):
            w[at] = f"e{k}x{at}"
        yield " ".join(w)


def test_near_copies_in_one_bucket(spark, monkeypatch):
    """A family whose members share buckets though only some are alike: rounds and the last comparison lose no link."""
    import corpus_pipeline
    from graphloom.llm import overlap

    rng = np.random.default_rng(11)
    texts = list(family(160, 60, 5, rng)) + list(family(60, 90, 9, rng))
    rows = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    want = plain_survivors(rows.collect())
    assert 5 < len(want) < 200
    for speakers in (1, 8):
        monkeypatch.setattr(overlap, "SPEAKERS", speakers)
        assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, rows, "").collect()} == want


def test_stages_with_clashing_names(spark, docs):
    """Columns named as the operators name theirs stay as they are; a table may lack n_chars."""
    import corpus_pipeline

    names = ("_q", "_q_key", "_row", "_place", "_spans", "_redacted", "doc", "rank", "_fp", "_set", "_n", "_bands", "hashes")
    few = docs.limit(40).drop("n_chars").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, few, "")
        assert out.columns == few.columns, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, few, "").count() >= 40


def test_near_duplicate_rows(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"t{k}x{i}" for i in range(60))
    rows = [(None, text(k)) for k in range(5)] + [(7, text(5)), (7, text(6)), (None, text(6)), (9, text(0)), (None, text(1)), (3, text(7)), (3, text(7)), (None, None), (None, "")]
    df = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter([(9, text(0)), *((None, text(k)) for k in range(1, 5)), (7, text(5)), (7, text(6)), (3, text(7)), (None, "")])
    once = corpus_pipeline.near_duplicate_stage(spark, odd(spark).select(*df.columns), "")
    assert once.count() == once.select("doc_id").distinct().count()


def test_random_keys():
    encoding = secrets.load_encoding(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())
    rng = np.random.default_rng(9)
    up, low, ten = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for letters in (up + "234567", low + "234567", low + ten, up + ten, low, up, up + low + ten):
        for size in (32, 52):
            for key in ("".join(rng.choice(list(letters), size)) for _ in range(200)):
                if len(key) / len(encoding.encode_ordinary(key)) < 2.2 and not re.search("AKIA", key):
                    assert [(s, secrets.KINDS[k], e) for s, k, e in secrets.scan(f"use {key} here", encoding)] == [(4, "random", 4 + size)], key
    for plain in ("THIS_IS_A_LONG_CONSTANT_NAME", "path/to/some/file/v2/index_3", "2024-01-15-10-30-45-release", "HTTPServerRequestHandlerV2", "libfoo-1_2_3-4-x86_64-linux-gnu", "=" * 40, "ha" * 20, "Rechtsschutzversicherungsgesellschaften"):
        assert secrets.scan(plain, encoding) == [], plain


def test_license_keywords(spark):
    """No keyword shuts out a rule whose pattern matches."""
    spdx = [re.sub(r"\[(.)[^]]*\]|\(\?:.*?\)\?", lambda m: m[1] or "", f[3]) for f in licenses.FAMILIES]
    texts = [f"License: {x.upper()}" for x in spdx] + ["License: GPL-2.0-only", "released under the GNU GPL", "under the GNU LGPL license", "the GNU AGPL license", "distributed under the Expat license", "released under the Unlicence", "the PSF license", "Licensed under the PSF", "expat license"]
    low = [t.lower() for t in texts]
    for r in licenses.rules():
        assert all(r.keyword in t for t in low if re.search(r.pattern, t, re.ASCII)), r
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {d.label for d in r["_lic"].detections} for r in licenses.scan_licenses(rows).collect()}
    for i, t in enumerate(low):
        assert got[i] and got[i] <= {r.label for r in licenses.rules() if re.search(r.pattern, t, re.ASCII)}, t
