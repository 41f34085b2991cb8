import hashlib
import random

import numpy as np
import pytest

from wellcut.llm import byte_bpe, packing, token_counts
from wellcut.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "don't", "é", " ", "　", "1", "23", "!!", "...", "$$$", "<|endoftext|>", "<|endof", "日本", "😀", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "-", "_", "Ünder", "x" * 40, "ab" * 60, "0" * 50, "́", "'LL", "'re", "'d", "l'l", "r'e", "Ж", "ǅ", "\u2003", "\u1680", "\u205f", "\u2028", "à", "Ⅷ", "\x1d", "\x00", "​"]


@pytest.fixture(scope="module")
def lib():
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    return byte_bpe.Codec(vocabulary())


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", "x" * 20_000, "ab c" * 5_000, " " * 9_000, "\n" * 5_001 + "x"]


@pytest.mark.parametrize("fast", [True, False])
def test_encode_and_decode_against_the_library(lib, own, fast):
    c = own if fast else byte_bpe.Codec(vocabulary())
    c.fast = c.fast if fast else None
    for t in texts(1500 if fast else 300):
        ids = lib.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(c.encode(t.encode()), "<u4").tolist()
        assert got == ids, t
        assert c.ids(t.encode()) == c.encode(t.encode())
        assert c.decode(c.encode(t.encode())) == lib.decode(ids, skip_special_tokens=False) == t


def test_cuts_never_split_a_token(own):
    for t in own.vocab:
        for i in range(1, len(t)):
            assert own.inside[t[i - 1], t[i]]
    for t in texts(300, 2):
        b = t.encode()
        assert b"".join(own.fragments(b)) == b
        assert b"".join(own._fragment(f) for f in own.fragments(b)) == own._fragment(b) if b else True


def test_cuts_by_every_pair_of_the_table(own):
    """Cuts by plain rules: before an ASCII space, between others, after a single space; never inside a character or near an apostrophe."""
    pieces = ["a", "Z", "1", "é", "日", "ж", " ", "\n", "\t", ".", "$", "'", "\u3000", "\u2003", "\xa0", "\x1d", "-", "“"]
    unsure = lambda c: 0x1C <= ord(c) < 0x20
    space = lambda c: c.isspace() or unsure(c)
    rng = random.Random(5)
    n = 0
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(2, 9)))
        want, at = [], 0
        for i in range(1, len(t)):
            at += len(t[i - 1].encode())
            x, y = t[i - 1], t[i]
            if own.inside[x.encode()[-1], y.encode()[0]]:
                continue
            if y in " \t\n\x0b\x0c\r":
                want.append(at)
            elif (y == "'" and not (x.isascii() and x.isalnum())) or (x == "'" and y.isascii() and y.isalnum()) or unsure(x):
                continue
            elif not space(x) or (x in " \t\n" and (i < 2 or not space(t[i - 2]))):
                want.append(at)
        assert own.cuts(t.encode()).tolist() == want, t
        n += len(want)
    assert n > 5000


def test_more_fragments_than_white_space_gives(own):
    text = "Grüße, 2 naïve cafés (ça va?): 日本語のテキスト, x1y2z3; foo.bar\n" * 20
    assert len(own.fragments(text.encode())) > 2 * len(text.split())


def test_special_strings_as_plain_text(own):
    plain = tokenizers.Tokenizer.from_file(vocabulary())
    plain.encode_special_tokens = True
    t = "a <|endoftext|> b"
    assert np.frombuffer(own.encode(t.encode(), special=False), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_round_trip_of_a_table(docs_of, odd, lib):
    got = byte_bpe.round_trip(docs_of(odd), vocabulary()).collect()
    want = {i: t or "" for i, t in odd}
    assert len(got) == len(odd)
    for r in got:
        ids = lib.encode(want[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
    rows = byte_bpe.decode(byte_bpe.encode(docs_of(odd), vocabulary(), ["doc_id", "text"]), vocabulary())
    assert all((r["text"] or "") == r["wc__text"] for r in rows.collect())
    assert byte_bpe.round_trip(docs_of(odd).limit(0), vocabulary()).count() == 0


def brute_force_packing(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(window - n)
    return len(rooms)


def test_best_fit_decreasing():
    rng = np.random.default_rng(4)
    for window in (7, 64, 2048):
        for n in (1, 5, 300):
            lengths = rng.integers(1, window + 1, n)
            where, offset, k = packing.best_fit_decreasing(lengths, window)
            assert k == brute_force_packing(lengths.tolist(), window)
            for w in range(k):
                spans = sorted(zip(offset[where == w].tolist(), lengths[where == w].tolist(), strict=True))
                at = 0
                for o, s in spans:
                    assert o == at
                    at += s
                assert 0 < at <= window


def test_packing_of_a_table(docs_of, odd, lib):
    for block in (4096, packing.BLOCK_TOKENS):
        rows = packing.pack(docs_of(odd).repartition(2), vocabulary(), block_tokens=block).collect()
        pieces, sequences = {}, {}
        for r in rows:
            pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
            sequences.setdefault(r["sequence_id"], []).append(r)
            assert packing.zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= packing.WINDOW
        assert {k[0] for k in pieces} == {i for i, _ in odd}
        for i, t in dict(odd).items():
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
            copies = sum(x == i for x, _ in odd)
            got = sorted(pieces[i, len(ids)], key=lambda r: r["start"])
            assert sum(r["length"] for r in got) == copies * len(ids)
            at = {r["start"]: r["ids"] for r in got}
            assert b"".join(at[k] for k in sorted(at)) == np.array(ids, "<u4").tobytes()
    assert packing.pack(docs_of(odd).limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_separator_scan(spark, docs_of, odd, own, tmp_path, block, monkeypatch):
    rows = odd if block > 6 else [x for x in odd if x[0] != 5]
    monkeypatch.setattr(token_counts, "RUN", 3)
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(docs_of(rows).repartition(2), vocabulary(), block_bytes=block).collect())
    assert got == sorted((i or 0, len(own.encode((t or "").encode(), special=False)) // 4) for i, t in rows)
    # flat files: ids after the last separator, none at all, one torn by the end
    end = 50256
    ids = [end, 5, 6, end, end, 7] + [9] * 50 + [end, 8, 8]
    (tmp_path / "f.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "g.bin").write_bytes(b"")
    (tmp_path / "h.bin").write_bytes(np.array([3, end], "<u2").tobytes() + b"\x01")
    (tmp_path / "i.bin").write_bytes(b"\x01")
    found = token_counts.scan(spark, f"file://{tmp_path}", end, block_bytes=block).orderBy("file", "document").collect()
    assert [(r["file"], r["document"], r["n_tokens"], r["closed"]) for r in found] == [("f.bin", 0, 0, True), ("f.bin", 1, 2, True), ("f.bin", 2, 0, True), ("f.bin", 3, 51, True), ("f.bin", 4, 2, False), ("h.bin", 0, 1, True)]
    assert token_counts.token_counts(docs_of(rows).limit(0), vocabulary()).count() == 0


def test_ids_that_do_not_fit_are_refused(docs_of, tmp_path):
    with pytest.raises(Exception, match="too large for <u1"):
        token_counts.write_files(docs_of([(1, "some words of prose")]), vocabulary(), 0, f"file://{tmp_path}/x", "<u1").collect()
