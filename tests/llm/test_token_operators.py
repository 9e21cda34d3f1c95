import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from frayline.llm.chat_format import aligned, digests, escape, format_conversations, parse, render, unescape
from frayline.llm.packing import cuts, pack, plan_bins
from frayline.llm.token_counts import PreTokens, count_tokens
from tests.llm import texts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["It's <|endoftext|> DON'T <|startoftext|>", "İstanbul ΣΑΣ ﬁ ½ ǆ 中文 नमस्ते 😀👍🏽", "tab\tnew\n\n  line   nbsp x", "́é \x00 \x1c a"]


def test_pre_tokens_count_like_the_library():
    own, lib, rng = PreTokens(WORD), Tokenizer.from_file(WORD), random.Random(2)
    made = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), rng.randrange(0x1F300, 0x1F600)])) for _ in range(20)) for _ in range(300)]
    for text in ODD + made:
        found, special = own.of(text)
        assert special + sum(map(own.pieces, found)) == len(lib.encode(text, add_special_tokens=False).ids), text


def test_token_counts_of_all_rows(spark):
    docs, lib = texts.documents(spark, ODD), Tokenizer.from_file(WORD)
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for frequent in (400_000, 5):  # nearly all pre-tokens rare
        got = count_tokens(docs, WORD, frequent=frequent, limit=100).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert count_tokens(texts.empty(spark), WORD).count() == 0


def test_cuts_and_plans():
    assert cuts(2048, 2048) == [(0, 2048)] and cuts(5, 2) == [(0, 1), (1, 2), (3, 2)] and cuts(4, 2) == [(0, 2), (2, 2)]
    rng = random.Random(1)
    for _ in range(20):
        counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))}
        plans, used = plan_bins(counts, 100), {}
        for need, bins in plans:
            assert sum(x * c for x, c in need.items()) <= 100 and bins > 0
            for x, c in need.items():
                used[x] = used.get(x, 0) + c * bins
        assert used == counts
    # greedily 60 + 30 leaves 10; 20 + 20 fill the gap of 40 that 30 leaves
    assert ({60: 1, 20: 2}, 1) in plan_bins({60: 1, 30: 1, 20: 2}, 100)


def test_packing_round_trip(spark):
    docs, lib = texts.documents(spark, [*ODD, "<|endoftext|> a<|endoftext|>"]), Tokenizer.from_file(BYTE)
    capacity = 64
    rows = pack(docs, BYTE, capacity).collect()
    ids = {}
    for r in docs.collect():
        whole = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (a, n) in enumerate(cuts(len(whole), capacity)):
            key = (str(r.doc_id), k, a, n, zlib.crc32(whole[a : a + n].tobytes()))
            ids[key] = ids.get(key, 0) + 1
    got, sequences = {}, {}
    for r in rows:
        key = (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == ids
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(sequences) <= least * 1.05 + 1
    assert pack(texts.empty(spark), BYTE).count() == 0


def test_chat_template_is_reversible():
    rng = random.Random(4)
    bits = ["<|", "|>", "\\", "|", "<", "n", "\n", "<|end|>", "<|turn|>", "é😀", "</s>[INST]"]
    for _ in range(200):
        turns = [("".join(rng.choices(bits, k=3)), "".join(rng.choices(bits, k=rng.randrange(9)))) for _ in range(4)]
        text, _ = render(turns)
        assert parse(text) == turns
        assert all(unescape(escape(x)) == x for _, x in turns)


def test_mask_covers_each_character_once():
    lib, rng = Tokenizer.from_file(BYTE), random.Random(5)
    for _ in range(100):
        turns = [(rng.choice(["user", "assistant"]), "".join(rng.choices([" ", "\n", "a", "né", "😀👍🏽", "中", "<|"], k=rng.randrange(12)))) for _ in range(5)]
        text, spans = render(turns)
        mask, kept = aligned(lib.encode(text, add_special_tokens=False).offsets, spans)
        assert kept == [s for s in spans if s[0] < s[1]] and (not kept or mask.any())


def test_conversations(spark):
    rows = [(1, 1, "assistant", " hi\n"), (1, 0, "user", "<|end|>"), (2, 0, "assistant", None), (None, None, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (3, 0, "assistant", "a" * 20_000)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in digests(format_conversations(table, BYTE)).collect()}
    assert set(got) == {1, 2, 3, None}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n<|end|>\nassistant\n hi\n\n") and got[1].loss_sha256 == sha(" hi\n") and got[1].loss_chars == 4
    assert got[2].loss_chars == 0 and got[2].n_turns == 1 and got[None].turns_sha256 == sha("\n\n")
    assert got[3].n_turns == 3 and got[3].loss_chars == 20_002
    assert digests(format_conversations(table.limit(0), BYTE)).count() == 0
