"""Corpus operators against brute force, round trips and the cases that each docstring defines."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontamination, langid, licenses, media, neardup, packing, quality, shingles, token_files, toxicity, wordpieces
from larkspur.llm.tokens import Encoder
from larkspur.llm.training import isotonic
from larkspur.llm.wavelet import WaveletShard, encode_shard

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  a  b\n\n c ", "don't we'll, 3.14 x.y", "ÀÉ İ x́ 漢字 12345", "\n", "a\x00b", "<|endoftext|> q", "\x1c \x1d", "é ́b", " a ", "word " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, rep long"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    rows = [(k, t, "en", None, None, 1.0, 2, 3) for k, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None, None, None, None), (3, "don't we'll, 3.14 x.y", "en", None, None, None, None, None), (3, "another text of the same id here", "de", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(docs, vocabulary):
    texts = [t or "" for t in ODD] + [r.text for r in docs.select("text").collect()]
    e = Encoder(vocabulary)
    for _ in range(2):
        flat, ends = e.encode(texts)
        for k, t in enumerate(texts):
            assert flat[ends[k] : ends[k + 1]].tolist() == e.library.encode(t, add_special_tokens=False).ids, t[:40]


#: Characters at which folding, marks, digits, blanks or stops meet.
_POOL = [*"aAbZ 019 ,.'!?-_\n\t", *"İıßéΣςक़क़יִ漢字かな한٣²½ﬁǅŉ\xa0\u2009\u3000\x1c\x85Åñöกำɐ", "e\u0301", "\u0307", "\u0338", "\u200d", "\U0001f600", "'s", "'T", "3.14", "1,000", "...", "\ue000", "\x00", "د"]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library_on_random_strings(vocabulary):
    rng = np.random.default_rng(11)
    e = Encoder(vocabulary)
    for _ in range(10):
        texts = ["".join(_POOL[k] for k in rng.integers(len(_POOL), size=rng.integers(15))) for _ in range(1000)]
        texts += ["".join(chr(c) for c in rng.choice([*range(32, 127), *range(160, 0x3000, 7), 44, 46, 32, 32], size=rng.integers(13))) for _ in range(1000)]
        flat, ends = e.encode(texts)
        for k, got in enumerate(e.library.encode_batch(texts, add_special_tokens=False)):
            assert flat[ends[k] : ends[k + 1]].tolist() == got.ids, texts[k]


def _greedy(pieces: set[bytes], word: bytes, longest: int) -> int:
    n = at = 0
    while at < len(word):
        at = max(e for e in range(at + 1, min(len(word), at + longest) + 1) if word[at:e] in pieces)
        n += 1
    return n


def test_word_piece_counts(docs):
    automaton, mark = wordpieces.load_vocabulary(wordpieces.VOCABULARY)
    import json

    from larkspur.llm.tokens import _byte_table, vocabulary_path

    byte = {c: b for b, c in _byte_table().items()}
    pieces = {bytes(byte[c] for c in t) for t in json.load(open(vocabulary_path(wordpieces.VOCABULARY)))["model"]["vocab"] if all(c in byte for c in t)}
    longest = max(map(len, pieces))
    for w in {w for r in docs.select("text").limit(40).collect() for w in r.text.split()}:
        assert automaton.count(mark + w.encode()) == _greedy(pieces, mark + w.encode(), longest)


def test_word_pieces_with_continuation_marks():
    from tokenizers import Tokenizer
    from tokenizers.models import WordPiece

    vocab = ["[UNK]", "a", "ab", "abc", "##b", "##c", "##cd", "##d", "b", "##bcde"]
    library = Tokenizer(WordPiece({v: k for k, v in enumerate(vocab)}, unk_token="[UNK]"))
    own = wordpieces.Automaton([v.encode() for v in vocab[1:] if v[:2] != "##"], [v[2:].encode() for v in vocab if v[:2] == "##"])
    for w in ("a", "ab", "abcd", "abcde", "abbbcd", "x", "abx", "bcd", "abcdbcde", "abcdcd"):
        assert own.count(w.encode()) == len(library.encode(w).ids), w


def test_token_counts_of_edges(edge, nothing):
    got = wordpieces.token_counts(edge).collect()
    assert len(got) == edge.count() and {(r.n_words, r.n_tokens) for r in got if r.doc_id in (0, 1)} == {(0, 0)}
    assert wordpieces.token_counts(nothing).count() == 0


def test_adpcm_and_companding_round_trips():
    rng = np.random.default_rng(1)
    pcm = (np.cumsum(rng.integers(-400, 400, 2000)).clip(-20000, 20000)).astype(np.int16)
    back = media.decode_adpcm(media.encode_adpcm(pcm))[: len(pcm)]
    assert np.abs(back.astype(int) - pcm).mean() < 200
    for tag, table in media.EXPAND.items():
        assert len(set(table.tolist())) >= 255 and (np.sort(table) == -np.sort(-table)[::-1]).all(), tag
    blob = media.wav(media.MULAW, 8000, b"\x00\xff" * 32)
    assert media.parse_wav(blob)[3] == b"\x00\xff" * 32 and media.to_pcm(blob)[1][:2].tolist() == [-32124, 0]
    assert media.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]


def test_expansion_and_adpcm_equal_scalar_decoders():
    # published values of the two companding laws
    assert {c: int(media.EXPAND[media.MULAW][c]) for c in (0, 1, 0x7F, 0x80, 0xFE, 0xFF)} == {0: -32124, 1: -31100, 0x7F: 0, 0x80: 32124, 0xFE: 8, 0xFF: 0}
    assert {c: int(media.EXPAND[media.ALAW][c]) for c in (0x55, 0xD5, 0x2A, 0xAA, 0x00, 0x80)} == {0x55: -8, 0xD5: 8, 0x2A: -32256, 0xAA: 32256, 0x00: -5504, 0x80: 5504}
    for code in range(256):  # sign, segment and step, one code at a time
        u = code ^ 0xFF
        mu = (2 * (u & 15) + 33 << (u >> 4 & 7)) - 33
        assert media.EXPAND[media.MULAW][code] == (-4 * mu if u & 128 else 4 * mu)
        a = code ^ 0x55
        step, segment = a & 15, a >> 4 & 7
        al = 2 * step + 1 if segment == 0 else 2 * step + 33 << segment - 1
        assert media.EXPAND[media.ALAW][code] == (8 * al if a & 128 else -8 * al)
    data = np.random.default_rng(8).integers(0, 256, 64 * 20, dtype=np.uint8)
    data[2::64] %= 89
    want = []
    for block in data.reshape(-1, 64):
        value, index = int(block[:2].view("<i2")[0]), int(block[2])
        want.append(value)
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                move = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                want.append(value)
    assert media.decode_adpcm(data.tobytes()).tolist() == want
    assert media.to_pcm(media.wav(media.ALAW, 8000, bytes(range(256))))[1].tolist() == media.EXPAND[media.ALAW].tolist()


@pytest.mark.parametrize("tag", [media.MULAW, media.ALAW])
def test_media_digests(spark, edge, nothing, tag):
    import hashlib

    got = media.digests(media.store_pcm(media.decode_media(media.store_texts(edge, tag=tag), 4000))).collect()
    want = []
    for r in edge.collect():
        text = (r.text or "").encode()
        payload = text + b"\0" * (-len(text) % 64 or 64 * (not text))
        form = b"fmt " + (18).to_bytes(4, "little") + tag.to_bytes(2, "little") + b"\1\0" + (8000).to_bytes(4, "little") * 2 + b"\1\0\x08\0\0\0"
        body = b"WAVE" + form + b"data" + len(payload).to_bytes(4, "little") + payload
        file = b"RIFF" + len(body).to_bytes(4, "little") + body
        audio = [int(media.EXPAND[tag][c]) for c in payload]
        half = b"".join(v.to_bytes(2, "little", signed=True) for v in audio[::2])
        steps = sum(abs(y - x) for x, y in zip(audio, audio[1:]))
        rms = (sum(v * v for v in audio) // len(audio)) ** 0.5
        crossings = sum((x >= 0) != (y >= 0) for x, y in zip(audio, audio[1:]))
        said = f"n={len(audio)} peak={max(map(abs, audio))} rms={rms:.0f} zc={crossings} step={steps // (len(audio) - 1)}"
        want.append((r.doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), said, len(half) + 44, hashlib.sha256(media.wav(media.PCM, 4000, half)).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert media.digests(media.store_pcm(media.decode_media(media.store_texts(nothing)))).count() == 0


def _pieces_cover(rows, docs_ids):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, ids in docs_ids.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return [sum(p.length for p in ps) for ps in by_seq.values()]


def test_packing(spark, docs, edge, nothing):
    library = Encoder(packing.VOCABULARY).library
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.select("doc_id", "text").collect()}
    fills = _pieces_cover(packing.pack(docs).collect(), want)
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills)
    some = packing.pack(edge).collect()
    assert {r.doc_id for r in some} == {r.doc_id for r in edge.collect()} and packing.pack(nothing).count() == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(3)
    p = packing.SumOfSquares(16)
    for size in rng.integers(1, 16, 400):
        n, best = p.counts.copy(), None
        for h in range(17 - size):
            if h and not n[h]:
                continue
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 16:
                m[h + size] += 1
            best = min(best, (m[1:16] ** 2).sum()) if best is not None else (m[1:16] ** 2).sum()
        p.place(int(size))
        assert (p.counts[1:16] ** 2).sum() == best


def test_wavelet_shard():
    rng = np.random.default_rng(5)
    ids = rng.choice([3, 7, 7, 500, 50256], 3000)
    s = WaveletShard(encode_shard(ids, np.array([1000, 2000]), np.array([5, 9])))
    assert (s.all_ids() == ids).all()
    for i in (0, 511, 512, 2999):
        assert s.access(i) == ids[i]
    for v in (3, 7, 50256, 4, 1 << 20):
        where = np.flatnonzero(ids == v)
        assert s.count(v) == len(where) and s.count(v, 100, 2000) == ((where >= 100) & (where < 2000)).sum()
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
            assert s.locate(v, k) == where[k]


def test_token_files(docs, edge, nothing):
    library = Encoder(token_files.VOCABULARY).library
    got = token_files.read_token_files(token_files.write_token_files(docs, shard_tokens=5000)).orderBy("start").collect()
    at = 0
    for r, d in zip(got, docs.orderBy("doc_id").select("doc_id", "text").collect(), strict=True):
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(edge)).count() == edge.count()
    small = token_files.write_token_files(edge, shard_tokens=1)  # every document is a file of its own
    assert small.count() == edge.count() and token_files.read_token_files(small).agg(F.sum("n_tokens")).collect()[0][0] == small.agg(F.sum("n_tokens")).collect()[0][0]
    assert token_files.read_token_files(token_files.write_token_files(nothing)).count() == 0


def test_license_scan(spark, nothing):
    mit = next(t for i, k, t in licenses.KNOWN if i == "MIT" and k == "license")
    rows = [(1, "Copyright (c) 2020 A\n\n" + mit.upper().replace("LICENSE", "LICENCE")), (2, "intro\n\nReleased under the MIT licence!\n\nmore"), (3, "plain"), (4, None), (5, ""), (6, "x\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.scope, r.license_id, r.n_units) for r in licenses.scan(df).collect()}
    assert {g for g in got if g[1] != "paragraph" or g[0] != 1} >= {(1, "text", "MIT", 1), (2, "paragraph", "MIT", 1), (6, "line", "MIT", 2)}
    assert {g[0] for g in got} == {1, 2, 6} and licenses.scan(nothing).count() == 0


def test_license_scan_of_line_ends_passages_and_own_tables(spark, edge):
    isc = next(t for i, k, t in licenses.KNOWN if i == "ISC")
    schema = "doc_id long, text string, scope string, digest string"
    rows = [
        (1, "intro\r\n\r\nReleased under the MIT License.\r\n\r\nmore"), (2, "intro\r\n \t\r\nReleased under\r\nthe MIT License.\r\n\r\nmore"), (3, "a\rReleased under the MIT License.\rb"),
        (4, "head\n\n(c) 2021 B\n\n" + isc + "\n\ntail"), (5, isc), (None, "Released under the MIT License."), (None, "Released under the MIT License."), (7, "x\nReleased under the MIT License.\n\nReleased under the MIT License."),
        (8, "word " * 300_000 + "\nReleased under the MIT License.\n" + "line\n" * 100_000),
    ]
    df = spark.createDataFrame([(*r, "scope", None) for r in rows], schema)
    got = {(r.doc_id, r.scope, r.license_id, r.n_units) for r in licenses.scan(df).collect()}
    assert got == {(1, "paragraph", "MIT", 1), (2, "paragraph", "MIT", 1), (3, "line", "MIT", 1), (4, "passage", "ISC", 1), (5, "text", "ISC", 1), (None, "text", "MIT", 2), (7, "paragraph", "MIT", 1), (7, "line", "MIT", 1), (8, "line", "MIT", 1)}
    own = spark.createDataFrame([("own", "terms", "first part\n\nsecond part"), ("none", "terms", "© 2020 x"), ("null", "terms", None)], "license_id string, kind string, text string")
    docs = spark.createDataFrame([(1, "x\n\nFirst part!\n\nSecond part.\n\ny"), (2, "Released under the MIT License."), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.scope, r.license_id) for r in licenses.scan(docs, known=own).collect()] == [(1, "passage", "own")]
    assert licenses.scan(edge).count() == 0


def _brute(rows):
    sets = {k: shingles.shingle_set((t or "").encode()) for k, t in rows}
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if shingles.linked(sets[a], sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("long_list,block,split", [(32, 400, 100_000), (2, 3, 4)])
def test_near_duplicates(spark, docs, monkeypatch, long_list, block, split):
    monkeypatch.setattr(neardup, "LONG", long_list)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SPLIT", split)
    base = "the quick brown fox jumps over a lazy dog and then walks on to the far green hills of the old country where it sleeps until morning comes again".split()
    extra = [(10_000 + k, " ".join(w if j % 29 != k else f"edit{k}" for j, w in enumerate(base))) for k in range(28)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + extra + [(20_000, None), (20_001, ""), (20_002, "two words"), (20_003, "TWO  Words")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == _brute(rows)


def test_block_links_of_the_smallest_member(spark):
    text = " ".join(f"word{k}" for k in range(60))
    raw = spark.createDataFrame([(1, text.encode()), (2, b"something else that stands alone in its list of members"), (3, (text + " end").encode())], "rep long, t binary")
    reps = neardup.features(raw, "t", "rep").withColumnRenamed("doc_id", "rep")
    long_lists = spark.createDataFrame([(k, k, 1) for k in (1, 2, 3)], "rep long, c long, head long")
    assert [tuple(sorted(r)) for r in neardup._block_links(long_lists, reps, raw, 75).collect()] == [(1, 3)]


@pytest.mark.parametrize("pieces", [1000, 3])
def test_components_of_hubs_and_paths(spark, monkeypatch, pieces):
    from larkspur.llm import common
    from larkspur.llm.components import components

    monkeypatch.setattr(common, "PIECES", pieces)
    edges = [(k, 500) for k in range(100)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)] + [(7, 7), (None, 3), (3000, 3001), (3001, 3000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {**{k: 0 for k in [*range(1, 100), 500]}, **{k: 1000 for k in range(1001, 1100)}, **{k: 2000 for k in range(2001, 2041)}, 3001: 3000}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force_on_a_thousand_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


def test_single_sets_of_split_lists_are_leaders(spark):
    postings = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 11, 6), (2, 0, 12, 5), (3, 0, 13, 5), (3, 0, 14, 6)], "bucket long, salt int, rep long, central long")
    got = sorted((r.bucket, r.salt, r.rep, r.leader) for r in neardup._lists(postings).collect())
    assert got == [(1, 1, 10, 10), (1, 2, 11, 11), (3, 0, 13, 14), (3, 0, 14, 14)]


def test_near_duplicates_of_edges(edge, nothing):
    got = neardup.near_duplicates(edge).collect()
    assert len(got) == edge.count() and all(r.component_id is None for r in got if r.doc_id is None)
    assert len({r.component_id for r in got if r.doc_id == 3}) == 1
    assert neardup.near_duplicates(nothing).count() == 0


def test_decontamination(spark, edge, nothing):
    items = spark.createDataFrame([(1, "On Monday Alice bought 12 kg of red apples for the school and gave Bob 3 kg of them back"), (2, "tiny item"), (3, None)], "item_id long, text string")
    rows = [
        (1, "Noise first. ON MONDAY ALICE BOUGHT 12 KG OF RED APPLES FOR THE SCHOOL AND GAVE BOB 3 KG OF THEM BACK and more"),
        (2, "x y. On Monday Clara bought 77 lb of red apples for the school and gave Dan 5 lb of them back".replace("lb", "pounds")),
        (3, "On Monday Alice bought a car and nothing else happened in the town that day at all"),
        (4, "Tiny, item!"), (5, None),
    ]
    got = {(r.doc_id, r.item_id): r.slots_changed for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got.keys() == {(1, 1), (2, 1), (4, 2)} and got[1, 1] == 0 and got[2, 1] >= 4
    assert decontamination.contaminated(edge, items).count() == 0
    assert decontamination.contaminated(nothing, items).count() == 0
    assert decontamination.contaminated(edge, items.limit(0)).count() == 0


def _found_by_brute_force(texts, items, least=0.75):
    """{(text number, item number): (covered, changed)} by comparing every window of every text with every window of every item."""

    def words(t):
        out, start = [], True
        for w in t.replace("\n", " \x00 ").split():
            if w == "\x00":
                start = True
                continue
            core = re.sub(r"[\W_]+", "", w)
            if core:
                low = core.lower()
                kind = "#" if re.fullmatch(r"[0-9]+(st|nd|rd|th)?", low) or low in decontamination.NUMBER_WORDS else "u" if low in decontamination.UNITS else "N" if core[0].isupper() and core[1:].islower() and not start else ""
                out.append((low, kind))
            start = w[-1] in ".!?:"
        return out

    def windows(ws):
        if 0 < len(ws) < 5:
            return [(0, ("whole", *[w for w, _ in ws]), [w if k else None for w, k in ws])]
        out = []
        for p in range(len(ws) - 4):
            part = ws[p : p + 5]
            slots = [w if k else None for w, k in part]
            out.append((p, tuple(w for w, _ in part), slots))
            if 0 < sum(1 for _, k in part if k) <= 3:
                out.append((p, ("template", *[k or w for w, k in part]), slots))
        return out

    found = {}
    split = [windows(words(t or "")) for t in texts]
    for n, item in enumerate(items):
        size, mine = len(words(item or "")), windows(words(item or ""))
        for d, theirs in enumerate(split):
            pairs = [(a, b) for a in mine for b in theirs if a[1] == b[1]]
            seen = {}
            for a, b in pairs:
                for x, y in zip(a[2], b[2], strict=True):
                    if x and y:
                        seen[x, y] = seen.get((x, y), 0) + 1
            if any(list(seen.values()).count(v) > 1 and x != y for (x, y), v in seen.items()) and len({x for x, _ in seen}) < len(seen):
                continue  # equally frequent pairings that exclude each other: either choice is right
            ahead = {}
            for (x, y), _ in sorted(seen.items(), key=lambda p: (-p[1], p[0][0] != p[0][1])):
                if x not in ahead and y not in ahead.values():
                    ahead[x] = y
            kept = [(a, b) for a, b in pairs if all(ahead.get(x) == y for x, y in zip(a[2], b[2], strict=True) if x and y)]
            best = (0, 0)
            for piece in {b[0] // size for _, b in kept}:
                here = [(a, b) for a, b in kept if piece <= b[0] // size < piece + 3]
                covered = {a[0] + j for a, _ in here for j in range(min(5, size))}
                changed = {a[0] + j for a, b in here for j, (x, y) in enumerate(zip(a[2], b[2], strict=True)) if x and y and x != y}
                best = max(best, (len(covered), -len(changed)))
            if size and best[0] >= least * size:
                found[d, n] = best[0], -best[1]
    return found


def test_decontamination_equals_brute_force(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = np.random.default_rng(4)
    for k, (_, t) in enumerate(items[:20]):  # pieces of items, with other numbers and a word put in
        ws = t.split()
        cut_off = ws[: int(len(ws) * rng.uniform(0.6, 1))]
        cut_off.insert(int(rng.integers(len(cut_off))), "inserted")
        rows.append((10_000 + k, "Before it. " + " ".join(str(int(w) + 7) if w.isdigit() else w for w in cut_off) + " and after it."))
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = _found_by_brute_force([t for _, t in rows], [t for _, t in items])
    assert {(r.doc_id, r.item_id): (r.covered, r.slots_changed) for r in got} == {(rows[d][0], items[n][0]): v for (d, n), v in want.items()}
    assert len(want) > 10


def test_decontamination_of_numbers_and_repeats(spark):
    items = [(1, "3 5 8 12 20 33 40 51"), (2, " ".join(f"the cat {k * 3} is {k}" for k in range(30)))]
    rows = [(1, "910 22 71 34 65 86 17 48"), (2, "so 3 5 8 12 20 33 40 51 it is"), (3, " ".join(map(str, range(8000)))), (4, " ".join(f"the cat {k} is {k + 1}" for k in range(4000)))]
    rows += [(None, rows[1][1]), (2, "another text of the same id"), (2, rows[1][1])]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == [(2, 1), (None, 1)]


@pytest.mark.parametrize("rare", [2, 1000])
def test_block_max_search_is_exact(rare):
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(40, 6, replace=False))
        w = rng.random(6)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    vectors += vectors[:20]  # ties go to the lower number
    index = toxicity.BlockMaxIndex(vectors, 40, block=16, rare=rare)
    dense = np.zeros((320, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for without in (None, list(range(320))):
        for i, (found, cosine) in enumerate(index.search(vectors, 10, without)):
            full = dense @ dense[i]
            if without is not None:
                full[i] = 0
            want = [x for x in np.lexsort((np.arange(320), -np.round(full, 9)))[:10] if full[x] > 0]
            assert found.tolist() == want and np.allclose(cosine, full[want])
    assert [len(f) for f, _ in index.search([(np.zeros(0, np.int64), np.zeros(0))], 3)] == [0]
    assert [len(f) for f, _ in toxicity.BlockMaxIndex([], 5).search([(np.array([1]), np.array([1.0]))], 3)] == [0]


def test_block_index_keeps_no_copy_and_no_wide_matrix():
    """An executor holds an index for each of its workers, so it takes its model's arrays and keeps weights of frequent terms sparse."""
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(640):
        t = np.unique(np.concatenate([rng.choice(2000, 60, replace=False), [2000]]))
        w = rng.random(len(t))
        vectors.append((t.astype(np.int32), w / np.sqrt((w * w).sum())))
    start = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])])
    terms, weights = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])
    model = toxicity.ToxicityModel(pa.array([str(k) for k in range(2001)]), np.ones(2001), start, terms, weights, np.ones(640), list(range(640)), 0.0)
    index = toxicity.BlockMaxIndex(model.vectors, 2001, rare=100)
    plain = model.index
    assert np.shares_memory(plain.terms, model.terms) and np.shares_memory(plain.weights, model.weights)
    held = [x for v in vars(index).values() for x in (v if isinstance(v, list) else [v])]
    size = sum(a.nbytes for x in held for a in (x if isinstance(x, tuple) else [x]) if isinstance(a, np.ndarray))
    assert index.frequent > 1000 and size < 640 * index.frequent * 4 / 2  # half of a matrix of all examples
    wide = np.zeros((640, 2001))
    for k, (t, w) in enumerate(vectors):
        wide[k, t] = w
    for found in (index.search(vectors[:40], 9, list(range(40))), plain.search(vectors[:40], 9, list(range(40)))):
        for k, (near, cosines) in enumerate(found):
            cos = wide @ wide[k]
            cos[k] = -1
            assert near.tolist() == np.lexsort((np.arange(640), -np.round(cos, 9)))[:9].tolist()
            assert np.allclose(cosines, cos[near])


def _held_out(spark, query, label, folds, fold):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r[label] is not None}
    rows = query(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return rows, np.array([r.predicted for r in held]), np.array([truth[r.doc_id] for r in held])


def test_held_out_toxicity(spark):
    from larkspur.llm.queries import op6_toxicity

    rows, said, true = _held_out(spark, op6_toxicity, "toxic", 5, 0)
    assert said[true == 1].mean() >= 0.9 and 1 - said[true == 0].mean() >= 0.98 and len(true) > 700
    assert np.mean([r.similarity > 0 for r in rows]) > 0.99


def test_neighbours_equal_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    dense = np.zeros((len(model.vectors), len(model.idf)))
    for i, (t, w) in enumerate(model.vectors):
        dense[i, t] = w
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    texts = docs.select("doc_id", "text").limit(200).collect()
    for r, (terms, w) in zip(texts, map(model.vector, toxicity._counts([r.text for r in texts], model.vocabulary)), strict=True):
        full = dense[:, terms] @ w
        near = np.lexsort((np.arange(len(full)), -np.round(full, 9)))[: toxicity.K]
        assert got[r.doc_id].neighbours == [model.example_ids[i] for i in near if full[i] > 0]


def test_toxicity_and_quality_fit(spark, edge, nothing):
    words = [f"w{k}" for k in range(60)]
    rng = np.random.default_rng(0)
    rows = []
    for k in range(400):
        t = list(rng.choice(words, 30))
        y = int(k % 4 == 0)
        if y:
            t[int(rng.integers(30))] = "horrid"
        rows.append((k, " ".join(t) if k % 3 else " ".join(t).upper() + "!!!", y, int(k % 3 > 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, q int")
    model = toxicity.fit(df)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, _, y, _ in rows]) > 0.97
    assert toxicity.score(edge, model).count() == edge.count() and toxicity.score(nothing, model).count() == 0
    assert {r.score for r in toxicity.score(edge, toxicity.fit(df.limit(0))).collect()} == {0.0}
    good = quality.fit(df.withColumn("label", F.col("q")))
    s = {r.doc_id: r.score for r in quality.score(df, good).collect()}
    assert np.mean([(s[k] >= 0.5) == bool(q) for k, _, _, q in rows]) > 0.97
    assert quality.score(edge, good).filter("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in quality.score(edge, quality.fit(df.withColumn("label", F.col("q")).limit(0))).collect()} == {0.5}


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_language_identification(docs, edge, nothing):
    model = langid.fit(docs.filter("doc_id % 4 <> 2"))
    held = docs.filter("doc_id % 4 = 2")
    got = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(edge, model).collect()}
    assert odd[0] == odd[1] == odd[5] == ("und", 0.0) and langid.identify(nothing, model).count() == 0
    assert {r.lang_pred for r in langid.identify(edge, langid.fit(nothing)).collect()} == {"und"}


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    d, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, d, SF)
        assert after.columns == columns, name
        d = after.cache()
        assert 0 < d.count() <= docs.count()
    left = {r.doc_id: r.text for r in d.collect()}
    assert len(set(_brute(left.items()).values())) == len(left)
    assert decontamination.contaminated(d, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert {r.doc_id for r in corpus_pipeline.pack(spark, d, SF).collect()} == set(left)


def test_pipeline_stages_on_edges(spark, edge, nothing):
    import corpus_pipeline

    mega = "a very long text of words " * 60_000
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    more = [(None, "x " + item + " y", "en", None, None, 0.0, 1, 1), (50, "x " + item + " y", "en", None, None, 0.0, 1, 1), (50, "one two three four five six seven eight", None, None, None, None, None, None)]
    more += [(51, mega, "en", None, None, None, None, None), (52, mega, "en", None, None, None, None, None), (None, mega, "en", None, None, None, None, None), (52, mega, "en", None, None, None, None, None)]
    docs = edge.union(spark.createDataFrame(more, edge.schema)).withColumn("_key", F.lit(7)).withColumn("component_id", F.lit("c"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and stage(spark, nothing, SF).count() == 0, name
        assert not Counter(map(tuple, after.collect())) - Counter(map(tuple, docs.collect())), name
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert [r.doc_id for r in unique if r.text == mega] == [51]
    assert sorted(r.text for r in unique if r.doc_id == 3) == sorted(r.text for r in docs.filter("doc_id = 3").select("text").distinct().collect())
    assert sum(r.doc_id is None for r in unique) == 1 and sum(r.text is None for r in unique) == 1
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert not any(r.text == "x " + item + " y" for r in clean) and len(clean) == docs.count() - 2
    pieces = corpus_pipeline.pack(spark, docs, SF)
    assert pieces.filter("start = 0").count() == docs.count() and corpus_pipeline.pack(spark, nothing, SF).count() == 0


def test_held_out_quality_and_language(spark):
    from larkspur.llm.queries import op5_quality, op7_language_id

    rows, said, true = _held_out(spark, op5_quality, "quality", 4, 2)
    assert (said == true).mean() > 0.97 and len(true) > 900 and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in op7_language_id(spark, "/root/testdata/sf0.1").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in got) and np.mean([r.lang_pred == truth[r.doc_id] for r in got if truth[r.doc_id]]) > 0.99


def test_token_counts_of_documents_equal_a_greedy_split(spark, docs):
    import json

    from larkspur.llm.tokens import _byte_table, vocabulary_path

    byte = {c: b for b, c in _byte_table().items()}
    pieces = {bytes(byte[c] for c in t) for t in json.load(open(vocabulary_path(wordpieces.VOCABULARY)))["model"]["vocab"] if all(c in byte for c in t)}
    longest, (_, mark) = max(map(len, pieces)), wordpieces.load_vocabulary(wordpieces.VOCABULARY)
    some = docs.orderBy("n_chars").limit(60)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpieces.token_counts(some).collect()}
    for r in some.collect():
        words = r.text.split()
        assert got[r.doc_id] == (len(words), sum(_greedy(pieces, mark + w.encode(), longest) for w in words))
