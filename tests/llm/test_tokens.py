import zlib
from array import array

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import packing as P
from tidemark.llm import token_files as TF
from tidemark.llm.tokens import ChunkEncoder, public_tokenizer

KINDS = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
ENCODERS = {k: ChunkEncoder(public_tokenizer(f), k, cache_entries=50) for k, f in KINDS.items()}

PARTS = ["a", "the", "'s", "'", " ", "  ", "\n", "\t", "é", "É", "ß", "é", ",", ".", "!?", "###", "12", "<|endoftext|>",
         " ", "\x1c", "漢字", "İ", "ﬁ", "don't", "​", "🙂", "ª", "THE", "Ünder,", "Σ"]


def whole(encoder, text):
    return array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("kind", KINDS)
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=16).map("".join)))
def test_chunks_give_the_tokenizers_ids(kind, text):
    assert ENCODERS[kind].encode(text) == whole(ENCODERS[kind], text)


def expected(rows, kind, end):
    e = ENCODERS[kind]
    return [(i, whole(e, t or "") + end.to_bytes(4, "little")) for i, t in rows]


def test_packing_covers_every_token_once(documents, odd):
    for docs in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = P.packing_digest(docs).collect()
        want = sorted((str(i), k // 4, min(len(b) - k, 4 * 4096) // 4, zlib.crc32(b[k:k + 4 * 4096]))
                      for i, b in expected(rows, "word", 1) for k in range(0, len(b), 4 * 4096))
        assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in out) == want
        by = {}
        for r in out:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        total = sum(r["length"] for r in out)
        assert len(by) <= -(-total // 4096) + 1


def test_sequences_hold_their_ids(documents):
    placed = P.pack_documents(documents, with_ids=True)
    for r in P.sequences(placed).limit(5).collect():
        assert len(r["ids"]) <= 4096
    for r in P.sequences(placed).collect():
        at = 0
        for i, offset in zip(r["doc_ids"], r["offsets"]):
            assert offset >= at
            at = offset


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_fillings_cover_the_histogram(histogram):
    out = P.complete_bins(histogram, 40)
    left = dict(histogram)
    for filling, times in out:
        assert sum(filling) <= 40 and times > 0
        for s in filling:
            left[s] -= times
    assert not any(left.values())
    total = sum(s * n for s, n in histogram.items())
    best_fit = P._fill(histogram, 40, lambda sizes, counts, room: P._best_fit(sizes, counts, room))
    assert -(-total // 40) <= sum(m for _, m in out) <= sum(m for _, m in best_fit)


def test_completion_finds_the_exact_filling():
    # best fit takes 6 first and wastes 1; 5 + 2 leaves nothing
    assert sum(P.completion([6, 5, 2], {6: 1, 5: 1, 2: 1}, 7)) == 7


def test_token_files_round_trip(tmp_path, spark, documents, odd, nothing):
    for k, docs in enumerate((documents, odd)):
        path = str(tmp_path / f"tokens{k}")
        TF.write_token_files(docs, path)
        out = TF.token_digest(TF.read_token_files(spark, path)).collect()
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = expected(rows, "byte", 0)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in out) == sorted(
            (str(i), len(b) // 4, zlib.crc32(b)) for i, b in want)
        ordered = sorted(out, key=lambda r: r["start"])
        assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:n]) for n in range(len(ordered))]
        ids = [r["doc_id"] for r in ordered]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    TF.write_token_files(nothing, str(tmp_path / "none"))
    assert TF.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_token_files_have_the_stated_layout(tmp_path, spark, documents):
    import glob

    import pyarrow.parquet as pq
    path = str(tmp_path / "layout")
    TF.write_token_files(documents, path, row_group_bytes=1 << 20)
    meta = pq.ParquetFile(sorted(glob.glob(path + "/*.parquet"))[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    tokens = next(c for name, c in columns.items() if name.startswith("tokens"))
    assert any("DICTIONARY" in e for e in tokens.encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    plan = TF.read_token_files(spark, path, tokens=False)._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1]


def test_packing_branches_over_fillings():
    import random
    from functools import lru_cache
    from tidemark.llm import packing as K

    def fewest(pieces, capacity):
        @lru_cache(None)
        def best(left):  # (sequences, room used in the last): subset by subset
            if not left:
                return 0, 0
            return min((n, u + pieces[i]) if u and u + pieces[i] <= capacity else (n + 1, pieces[i])
                       for i in range(len(pieces)) if left >> i & 1 for n, u in [best(left & ~(1 << i))])
        return best((1 << len(pieces)) - 1)[0]

    rng = random.Random(8)
    sets = [[24, 21, 20, 15, 15, 11, 7, 5]] + [[rng.randint(4, 30) for _ in range(rng.randint(7, 10))] for _ in range(150)]
    for pieces in sets:
        histogram = {s: pieces.count(s) for s in pieces}
        made = K.complete_bins(histogram, 40)
        assert all(sum(x) <= 40 for x, _ in made)
        assert sorted(s for x, m in made for s in x * m) == sorted(pieces)
        assert sum(m for _, m in made) == fewest(pieces, 40), pieces
