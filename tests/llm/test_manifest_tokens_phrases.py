"""Merkle manifests, token-id files and phrase collocations against brute force and round trips."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docgrid.llm import collocations, merkle_manifest, token_planes
from docgrid.llm._shared import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = public_tokenizers.path(token_planes.VOCABULARY)
#: Nulls, empty texts, a very long text, ties, repeated rows, one lone group.
ODD = [(1, None, None, None, None), (None, "no id", "en", "s", 2), (None, "nor here", "en", "s", 2), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "word " * 30_000, "en", "s", 1), (5, "a b c d", "en", "s", 1), (5, "a b c d", "en", "s", 1), (6, "a b c d", None, "s", 1), (7, "one two", "", "s", 1), (-8, "x" * 5000, "é", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], DOCS + ", root string, grp int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- Merkle manifest ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows):
    """(doc_id, leaf, slot, subroot, root, siblings with their sides) of rows as in DOCS."""
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i, brute_leaf((i, source, lang, n, text))))

    def tree(level):
        path, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, p in enumerate(at):
                path[k].append((level[p ^ 1] if p ^ 1 < len(level) else "", p & 1))
            at = [p // 2 for p in at]
            level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0], path

    out, made = [], []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        leaves = sorted(groups[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made.append((leaves, *tree([leaf for _, leaf in leaves])))
    root, above = tree([sub for _, sub, _ in made])
    for (leaves, sub, paths), up in zip(made, above):
        out += [(i, leaf, k, sub, root, [(s or None, bool(left)) for s, left in path + up]) for k, ((i, leaf), path) in enumerate(zip(leaves, paths))]
    return out


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("levels", "top"), [(10, 4096), (1, 2), (2, 5), (3, 1)])
def test_manifest_by_brute_force(spark, odd, levels, top):
    """Small blocks and a small top tree take as many rounds as a huge table would, more groups than the top may hold included."""
    rng = random.Random(levels)
    many = [(i, f"text {rng.random()}", rng.choice(["a", "a", "a", "b", "c", None, *(f"l{k}" for k in range(9))]), "s", i) for i in rng.sample(range(1000), 60)]
    for rows in (ODD, many):
        df = spark.createDataFrame(rows, DOCS)
        found = merkle_manifest.manifest(df, "doc_id", merkle_manifest.FIELDS, "lang", levels=levels, top=top)
        got = [(r.doc_id, r.leaf, r.slot, r.subroot, r.root, [(s.sib, s.left) for s in r.steps]) for r in found.collect()]
        assert ordered(got) == ordered(brute_manifest(rows))


def test_manifest_folds(spark, odd, none):
    found = merkle_manifest.manifest(odd, "doc_id", merkle_manifest.FIELDS, "lang", {"steps_": merkle_manifest.F.lit(1)})
    assert found.columns == ["doc_id", "lang", "steps_", "leaf", "slot", "subroot", "root", "steps"]
    rows = found.select("*", merkle_manifest.folded(merkle_manifest.F.col("leaf"), merkle_manifest.F.col("steps")).alias("fold"), merkle_manifest.folded(merkle_manifest.F.lit("0" * 64), merkle_manifest.F.col("steps")).alias("wrong")).collect()
    assert len(rows) == len(ODD) and all(r.fold == r.root != r.wrong for r in rows)
    assert merkle_manifest.manifest(none, "doc_id", merkle_manifest.FIELDS, "lang").count() == 0


def test_tampered_rows_are_found(spark):
    found = merkle_manifest.op11_merkle_manifest(spark, SF).collect()
    touched = {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert touched and {r.doc_id for r in found if not r.verified} == touched


# --- token-id files ---


def plain_ids(text, tokenizer=Tokenizer.from_file(VOCABULARY)):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [token_planes.END_ID]


def test_words_encode_as_whole_texts(monkeypatch):
    monkeypatch.setattr(token_planes, "REMEMBERED", 300)
    encoder, rng = token_planes.Encoder(VOCABULARY), random.Random(3)
    signs = [*"abcXYZ  \t\n\x0b\x0c\r\x1c\x85\xa0'.,<|>!0129éΣσßİ́̀각中日あ😀‍ ǅﬁ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "'S", " the ", "word. ", "x" * 70]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "z" * 5000, "word " * 5000]
    for at in range(0, len(texts), 40):
        got = encoder.ids([t.encode() for t in texts[at : at + 40]])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain_ids(t)[:-1] for t in texts[at : at + 40]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from([1, 8]), st.sampled_from([0, 9, 17, 32]))
def test_planes_round_trip(ids, bits, width):
    block = np.array(ids, np.uint64) % np.uint64(1 << width)
    planes = token_planes.to_planes(block.astype("<u4"), bits)
    assert len(planes) == 32 // bits and token_planes.from_planes(planes, len(block), bits).tolist() == block.tolist()


@pytest.mark.parametrize("bits", [1, 8])
def test_plane_file(monkeypatch, bits):
    monkeypatch.setattr(token_planes, "BLOCK", 16)
    rng = np.random.default_rng(bits)
    docs = [(k if k % 5 else None, rng.integers(0, 50_000, rng.integers(0, 60)).astype("<u4")) for k in range(40)]
    writer = token_planes.PlaneWriter(bits, 3, 4)
    for d in docs:
        writer.add(*d)
    data = writer.content() + token_planes.TAIL
    file, every = token_planes.PlaneFile(data), np.concatenate([d for _, d in docs])
    assert (file.partition, file.number, file.total, file.bits) == (3, 4, len(every), bits) and file.doc_ids == [i for i, _ in docs]
    for a, b in [(0, len(every)), (0, 0), (15, 17), (16, 32), (100, 333), (len(every) - 1, len(every))]:
        assert file.ids(a, b).tolist() == every[a:b].tolist()
    touched = []
    monkeypatch.setattr(token_planes.PlaneFile, "chunk", lambda self, k, f=token_planes.PlaneFile.chunk: touched.append(k) or f(self, k))
    file.ids(100, 110)
    assert touched == [6]  # the others are not decoded
    for broken in (data[:-1], b"XXXX" + data[4:], data[: len(data) // 2] + token_planes.TAIL):
        with pytest.raises((ValueError, struct.error)):
            token_planes.PlaneFile(broken)


def by_files(spark, docs, bits=8):
    path = new_path(spark, "test-planes")
    token_planes.write_planes(token_planes.encoded(docs, VOCABULARY), path, bits)
    return token_planes.with_starts(token_planes.read_planes(spark, path))


def test_token_files(spark, odd, none, monkeypatch):
    for bits in (1, 8):
        rows = by_files(spark, odd, bits).collect()
        assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, np.array(plain_ids(t), "<u4").tobytes()) for i, t, *_ in ODD)
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += len(r.ids) // 4
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i or 0))
    assert by_files(spark, none).count() == 0


def test_op12_by_brute_force(spark):
    got = sorted(tuple(r) for r in token_planes.op12_token_planes(spark, SF).collect())
    at, wanted = 0, []
    for i, text in sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        ids = plain_ids(text)
        wanted.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == wanted


# --- collocations ---


def brute_phrases(rows, max_n, min_count, inside, top):
    f, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    key = lang, tuple(words[i : i + n])
                    f[key] = f.get(key, 0) + 1
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, p), a in kept.items():
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (g, q), b in kept.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * b >= inside * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((g, rank, p.decode(), -a, l, r, totals[g], -s) for g, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("bits", "max_n", "top"), [(collocations.BLOOM, 4, 2000), (8, 4, 2000), (1 << 12, 5, 7), (64, 2, 5)])
def test_collocations_by_brute_force(spark, monkeypatch, bits, max_n, top):
    """A table of eight bits is full, so that it keeps no run away, and the counts are the same."""
    monkeypatch.setattr(collocations, "PORTION", 2000)
    rng = random.Random(bits)
    some = ["of the", "the", "New York", "new  york", "new\tyork city", "à la", "x.y", "a, b", "\x0bz\x0c", "<|", "end;", "of the world", "É", "q\r\nq"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), " ".join(rng.choices(some, k=rng.randint(0, 60)))) for _ in range(150)] + [(None, None), ("en", ""), ("fr", "la la " * 400), ("en", "solo")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int")
    counts = collocations.phrase_counts(df, max_n, 5, bits)
    got = sorted(tuple(r) for r in collocations.collocations(counts, 5, top=top).collect())
    assert got == brute_phrases(rows, max_n, 5, 80, top) and len(got) > 8


def test_collocations_of_nothing(spark, none):
    assert collocations.collocations(collocations.phrase_counts(none)).count() == 0


def test_scores_pass_64_bits(spark):
    big = 2**62
    counts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big), ("en", "a b", big - 1), ("en", "a b c", big // 2), ("en", "c", big), ("en", "b c", big - 2), ("en", None, big)], "lang string, phrase string, f bigint")
    found = {r.phrase: r for r in collocations.collocations(counts).collect()}
    assert found["a b"].score == 2_000_000 * (big - 1) // (2 * big + 1) and found["a b c"].score == min(2_000_000 * (big // 2) // x for x in (big + 1 + big - 2, big - 1 + big))
