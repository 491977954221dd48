"""op1, op2, op3: against the tokenizers themselves."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.llm import bpe, packing, pfor, pretok, queries
from folioquery.llm.shared import new_folder
from tests.llm.conftest import ODD

RANKS, LIBRARY = queries.vocabulary(queries.RANKS), queries.vocabulary(queries.TOKENIZER)
ALPHABET = st.text(st.sampled_from(list("'stremlvd ab12é½²한😀\n\t\r!-  　٣S")), max_size=40)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(LIBRARY)


@pytest.fixture(scope="module")
def tiktoken_own():
    import public_tokenizers
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, max_size=20))
def test_split(texts):
    import public_tokenizers
    import regex

    words, counts = pretok.split_words(texts)
    words, at = [w.decode() for w in words.to_pylist()], 0
    for text, n in zip(texts, counts):
        assert words[at : at + n] == regex.findall(public_tokenizers.PATTERN, text)
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=30), st.text("ab", max_size=80)), max_size=10))
def test_replay_is_tiktoken(tiktoken_own, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = bpe.encode_texts(texts, RANKS)
    assert [x.tolist() for x in got] == [tiktoken_own.encode_ordinary(t) for t in texts]
    assert [bpe.decode_ids(x, RANKS) for x in got] == [t.encode() for t in texts]


def test_library_encoder(library):
    texts = ["", "a <|endoftext|> b", "it's 'll  x\n\n", "naïve café 123", "a" * 3000]
    flat, counts = pretok.library_encoder(LIBRARY)(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=30), st.text("ab", max_size=80)), max_size=10))
def test_library_encoder_is_the_library(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    flat, counts = pretok.library_encoder(LIBRARY)(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])][: len(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_words_are_one_text_for_the_library(library, monkeypatch):
    import tokenizers

    asked = []

    class Counted:
        def __init__(self, own):
            object.__setattr__(self, "own", own)

        def __getattr__(self, name):
            return getattr(self.own, name)

        def __setattr__(self, name, value):
            setattr(self.own, name, value)

        @classmethod
        def from_file(cls, path):
            return cls(real.from_file(path))

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.own.encode_batch_fast(texts, **options)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(pretok, "_tables", {})
    texts = ["\n".join(f"Été{k}, {k * 7919}?! x{k:b}" for k in range(i, i + 1000)) for i in (0, 1000)]
    flat, counts = pretok.library_encoder(LIBRARY)(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < len(asked) < 20


def test_words_met_often_stay_known():
    asked = Counter()

    def encode_new(words):
        asked.update(words)
        return np.full(len(words), 2), np.array([[zlib.crc32(w), len(w)] for w in words], np.uint32).ravel()

    table = pretok.WordTable(encode_new)
    often = " the of and"
    for k in range(40):
        own = "".join(f" {n:x}" for n in range(k * 10_000, k * 10_000 + 10_000)).translate(str.maketrans("0123456789", "ghijklmnop"))
        flat, counts = table.encode([often, own])
        words = [" " + w for w in (often + own).split()]
        assert counts.tolist() == [6, 20_000] and flat.tolist() == [x for w in words for x in (zlib.crc32(w.encode()), len(w))]
    assert sum(asked.values()) > pretok.KNOWN_WORDS and [asked[w] for w in (b" the", b" of", b" and")] == [1, 1, 1]
    assert len(table.number) <= pretok.KNOWN_WORDS + 10_003


def test_bpe_query(odd, none, tiktoken_own):
    got = bpe.encode(odd, RANKS).collect()
    assert len(got) == len(ODD) and bpe.encode(none, RANKS).count() == 0
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(t or "")
    for r in got:
        ids = tiktoken_own.encode_ordinary(texts[r.doc_id][0])
        assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id][0].encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing(rows, odd, none, library):
    plain = [(i, f"topic{i % 7} shares words of topic{i % 7} number {i} " * (1 + i % 40)) for i in range(300)]
    for df, pairs in ((rows(plain), plain), (odd, ODD), (none, [])):
        pieces = packing.pack(df, LIBRARY, with_ids=True).collect()
        windows = defaultdict(list)
        per = defaultdict(list)
        for p in pieces:
            windows[p.sequence_id].append(p)
            per[p.doc_id].append(p)
            assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and len(bytes(p.ids)) == 4 * p.length > 0
        for own in windows.values():
            own.sort(key=lambda p: p.offset)
            assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) <= 1024
        want = defaultdict(list)
        for i, t in pairs:
            want[i].append(ids_of(library, t))
        for i, texts in want.items():
            assert sum(p.length for p in per[i]) == sum(map(len, texts))
            if len(texts) == 1:
                parts = sorted(per[i], key=lambda p: p.start)
                assert b"".join(bytes(p.ids) for p in parts) == np.array(texts[0], "<u4").tobytes() and all(p.doc_tokens == len(texts[0]) for p in parts)
        if df is not odd and pairs:
            short = [own for own in windows.values() if sum(p.length for p in own) < 1024]
            assert len(short) <= df.rdd.getNumPartitions()


def test_neighbours_share_words():
    rng = np.random.default_rng(1)
    docs = [rng.integers(100 * (k % 5) + 10, 100 * (k % 5) + 100, 300).astype(np.uint32) for k in range(60)]
    windows = defaultdict(set)
    for d, _, _, sequence, _ in packing.pack_shard(docs):
        windows[sequence].add(d % 5)
    assert np.mean([len(x) for x in windows.values()]) < 1.6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.booleans())
def test_blocks(values, small):
    ids = np.array(values, np.uint32)
    ids = ids % np.uint32(50) if small else ids
    blocks = pfor.encode_blocks(ids)
    if len(ids):
        starts = np.append(0, np.cumsum([len(b) for b in blocks]))
        assert (pfor.decode_blocks(b"".join(blocks), starts) == ids).all()


def test_bits_of_every_width():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 32, (3, 1024), dtype=np.uint64).astype(np.uint32)
    for w in range(1, 33):
        packed = pfor.pack(values, w)
        bits = (values.astype(np.int64)[:, :, None] >> np.arange(w)).astype(np.uint8) & 1
        assert (packed == np.packbits(bits.reshape(3, -1), axis=1, bitorder="little")).all()
        assert (pfor.unpack(packed, w) == values.astype(np.int64) & ((1 << w) - 1)).all()


def test_outliers_are_few_bytes():
    ids = np.arange(1024, dtype=np.uint32) % 16
    ids[500] = 4_000_000_000
    assert len(pfor.encode_blocks(ids)[0]) == pfor.HEAD.size + 512 + 6


def test_token_files(spark, rows, odd, none, library):
    from folioquery.llm.shared import filesystem

    pairs = [(i * 7 % 501, f"text {i} " * (i % 60)) for i in range(501)]
    for df, own in ((rows(pairs).repartition(5), pairs), (odd, ODD)):
        manifest = pfor.write(df, LIBRARY, new_folder(spark, "t"))
        got = sorted(pfor.read(manifest, with_ids=True).collect(), key=lambda r: r.start)
        assert len(got) == len(own) and [r.doc_id for r in got] == sorted((i for i, _ in own), key=lambda x: (x is not None, x or 0))
        texts = defaultdict(list)
        for i, t in own:
            texts[i].append(np.array(ids_of(library, t), "<u4").tobytes())
        at = 0
        for r in got:
            assert r.start == at and bytes(r.ids) in texts[r.doc_id] and r.n_tokens * 4 == len(bytes(r.ids)) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
            at += r.n_tokens
        row = manifest.orderBy("file_no").first()
        fs, path = filesystem(row.path)
        with fs.open_input_file(path) as stream:  # a range in the middle, through the index
            reader = pfor.Reader(stream, row.n_bytes)
            whole = reader.ids(0, reader.n_ids)
            assert (reader.ids(reader.n_ids // 3, reader.n_ids // 2) == whole[reader.n_ids // 3 : reader.n_ids // 2]).all()
    assert pfor.round_trip(none, LIBRARY).count() == 0
