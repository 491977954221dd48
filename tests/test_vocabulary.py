"""Model files, character maps and ids, against plain scans and, where they are there, public model files."""

import random
import struct

import pytest

from folioquery.functions import pieces as P
from folioquery.functions.embedding import UNKNOWN_PENALTY
from folioquery.operators import vocabulary as V
from folioquery.plans import queries_vocabulary as Q
from folioquery.plans.deploy import ship


def scanned(text, replacements, prefix=True, squeeze=True, escape=True):
    """The longest source at each place, by looking at all of them."""
    runs, at = [], 0
    while at < len(text):
        found = max((s for s in replacements if text.startswith(s, at)), key=lambda s: len(s.encode()), default=None)
        runs.append(text[at] if found is None else replacements[found])
        at += 1 if found is None else len(found)
    if not text:
        return ""
    out, before = "", squeeze
    for run in runs:
        if squeeze and before:
            run = run.lstrip(" ")
        if run:
            out, before = out + run, squeeze and run.endswith(" ")
    if squeeze and not out:
        return ""
    out = (" " * prefix + out).replace(" ", "▁" if escape else " ")
    return out.rstrip("▁" if escape else " ") if squeeze else out


MAPS = [{"a": "b"}, {"ab": "x", "abc": "y z", "b": "", "é": "e", "éa": "E ", "\t": " ", "ﬁ": "fi", "  ": "  ", "…": "..."}, Q.LETTERS | Q.SIGNS, {}]


@pytest.mark.parametrize("replacements", MAPS)
@pytest.mark.parametrize("settings", [{}, {"squeeze": False}, {"prefix": False, "escape": False}])
def test_character_maps(replacements, settings):
    draw = random.Random(len(replacements))
    letters = "aabbcé \t!.ﬁ…x\nß𝒳\0▁" + "".join(list(replacements)[:40])
    texts = ["", " ", "  ab ", "ab", "abc" * 3, "\0"] + ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(400)]
    own = P.Normaliser(P.charsmap(replacements), **settings)
    assert own.texts(texts) == [scanned(t, replacements, **settings) for t in texts]
    assert [own.texts([t])[0] for t in texts[:50]] == own.texts(texts)[:50]
    assert P.Normaliser(b"", **settings).texts(texts[:9]) == [scanned(t, {}, **settings) for t in texts[:9]]


def test_many_replacements():
    replacements = {chr(0x4E00 + k): f"{k} " for k in range(0, 3000, 2)} | {chr(0x4E00 + k) + "a": "A" for k in range(0, 3000, 6)}
    text = "".join(chr(0x4E00 + k % 3000) + "ab"[k % 2] for k in range(5000))
    assert P.Normaliser(P.charsmap(replacements)).texts([text]) == [scanned(text, replacements)]
    with pytest.raises(ValueError):
        P.charsmap({"": "x"})


def test_files_round_trip(spark, tmp_path):
    ship(spark)
    model = P.Model([("<unk>", 0.0, P.UNKNOWN), ("▁a", -1.5, P.NORMAL), ("é", -2.25, 4), ("", 0.0, P.CONTROL), ("x" * 300, -1e9, P.NORMAL)], P.charsmap({"a": "b"}), False, True, False, 2)
    read = P.Model.parse(model.file())
    assert read.pieces[:4] == model.pieces[:4] and read.pieces[4][1] == struct.unpack("<f", struct.pack("<f", -1e9))[0]
    assert (read.charsmap, read.prefix, read.squeeze, read.escape, read.kind) == (model.charsmap, False, True, False, 2)
    extra = P.encoded(99, 2**40) + P.encoded(50, b"more") + P.encoded(51, 1.5) + b"\xa1\x06" + b"8 bytes!"
    assert P.Model.parse(extra + model.file() + extra) == read
    assert P.Model.parse(P.encoded(1, P.encoded(1, b"a") + P.encoded(7, b"unknown in a piece"))).pieces == [("a", 0.0, P.NORMAL)]
    assert P.Model.parse(b"") == P.Model([])
    (tmp_path / "m").mkdir()
    for name in ("one", "two"):
        V.write_model(spark, model, f"file://{tmp_path}/m/{name}.model")
    (tmp_path / "m" / "empty.model").write_bytes(b"")
    rows = V.read_models(spark, str(tmp_path / "m")).orderBy("uri", "id").collect()
    assert [r.piece for r in rows] == [p[0] for p in model.pieces] * 2 and {r.uri.rsplit("/", 1)[1] for r in rows} == {"one.model", "two.model"}
    (tmp_path / "m" / "bad.model").write_bytes(model.file()[:-3])
    with pytest.raises(Exception, match="bad.model"):
        V.read_models(spark, str(tmp_path / "m")).collect()


@pytest.mark.parametrize("data", [b"\x80", b"\x0a\x05ab", b"\x0d\x00\x00", b"\x0b", b"\x07\x01", b"\x08\x01", b"\x0a\x03\x0a\x01\xff", b"\xff" * 12, b"\x00\x01"])
def test_damaged_files(data):
    with pytest.raises(P.DamagedModel):
        P.Model.parse(data)


def test_every_cut_file_is_an_error_or_a_shorter_model():
    whole = P.Model([("<unk>", 0.0, 2), ("a", -1.0, 1)], P.charsmap({"x": "y"})).file()
    cuts = 0
    for n in range(1, len(whole)):
        try:
            assert len(P.Model.parse(whole[:n]).pieces) <= 2
        except P.DamagedModel:
            cuts += 1
    assert cuts > len(whole) / 2
    with pytest.raises(P.DamagedModel):
        P.Normaliser(struct.pack("<I", 400) + b"short")


def best_way(text, usable, unknown):
    """Score and ids of the likeliest segmentation, by trying all."""
    least = min(s for s, _ in usable.values()) - UNKNOWN_PENALTY
    found = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(end):
            piece = text[start:end]
            score, k = usable.get(piece, (least, unknown) if end - start == 1 else (None, None))
            if score is not None and start in found:
                ways.append((found[start][0] + score, -start, [*found[start][1], k]))
        score, _, ids = max(ways, key=lambda w: w[:2])
        found[end] = score, ids
    ids = found[len(text)][1]
    return [k for n, k in enumerate(ids) if k != unknown or not n or ids[n - 1] != unknown]


@pytest.mark.parametrize("by_word", [True, False])
def test_ids(by_word):
    draw = random.Random(7)
    usable = {"▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab", "é"} | (set() if by_word else {"a▁b"})
    model = P.Model([("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL)] + [(p, -float(draw.randint(1, 8)) - k / 64, P.NORMAL) for k, p in enumerate(sorted(usable))], P.charsmap({"É": "é"}))
    encoder = P.Encoder(model)
    assert encoder.by_word == by_word
    known = {t: (s, k) for k, (t, s, kind) in enumerate(model.pieces) if kind == P.NORMAL}
    for _ in range(300):
        text = "".join(draw.choices("aabbÉéxz  ", k=draw.randint(0, 14)))
        ids = best_way(scanned(text, {"É": "é"}), known, 0)
        assert encoder.encode([text]) == [[3 if k == 0 else k + 1 for k in ids]], text
    assert encoder.framed(range(600)) == [0, *range(510), 2] and encoder.framed([]) == [0, 2]
    with pytest.raises(ValueError):
        P.Encoder(P.Model([], kind=2))
    assert P.Encoder(P.Model([])).encode(["", "a"]) == [[], [3]]


def test_ids_of_the_table(spark, sf):
    """The registered query on short texts against all ways of cutting them; ids of long ones fit the model."""
    ship(spark)
    model = Q.vocabulary(spark, sf)
    usable = {t: (s, k) for k, (t, s, kind) in enumerate(model.pieces) if kind == P.NORMAL}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in Q.ids(spark, sf).collect()}
    assert len(rows) == len(texts)
    tried = 0
    for doc_id, r in rows.items():
        ids = [int(x) for x in r.ids.split()]
        assert ids[0] == 0 and ids[-1] == 2 and len(ids) == r.n_given == min(512, r.n_ids + 2)
        if len(texts[doc_id]) < 400:
            tried += 1
            want = best_way(scanned(texts[doc_id], Q.LETTERS | Q.SIGNS), usable, 0)
            assert ids[1:-1] == [3 if k == 0 else k + 1 for k in want][:510]
    assert tried > 5 and any(r.n_ids > 600 for r in rows.values())
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "é" * 5000, "x")], "doc_id long, text string, ids string")
    assert {r.doc_id: (r.n_ids, len(r.ids)) for r in V.ids(odd, model).collect()}[1] == (0, 2)
    assert V.ids(odd.limit(0), model).count() == V.normalised(odd.limit(0), b"").count() == 0


def test_a_public_model_file():
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("sentencepiece")
    path = public.path("piece_bpe_32k.model")
    own = library.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = P.Model.parse(f.read())
    assert len(model.pieces) == own.get_piece_size() and model.kind == 2
    for k in (0, 1, 2, 3, 300, 5000, len(model.pieces) - 1):
        assert model.pieces[k][0] == own.id_to_piece(k) and model.pieces[k][1] == pytest.approx(own.get_score(k))
    assert P.Model.parse(model.file()).pieces == model.pieces
