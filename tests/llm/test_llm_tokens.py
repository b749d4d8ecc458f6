import binascii
import hashlib
import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

import odd  # noqa: E402

from broadsheet.llm import byte_bpe, packing, piece_counts  # noqa: E402


def random_texts(n):
    rnd = random.Random(5)
    alphabets = ["ab ", "aehtn ", "\n \tab", "éèüñ a", "的是一不 a", "<|>-_. a", "0123456789 ", "' stvre", "▁ a\n"]
    return ["".join(rnd.choices(rnd.choice(alphabets), k=rnd.randint(0, 60))) for _ in range(n)]


def every_character():
    step = lambda c: 1 if c < 0x3400 else 41
    points = (c for c in range(0x110000) if c % step(c) == 0 and not 0xD800 <= c < 0xE000)
    return [f"a{chr(c)} b {chr(c)}x  {chr(c)}\n {chr(c)}{chr(c)} 1{chr(c)}2" for c in points]


def own_tiktoken():
    ranks = byte_bpe.read_ranks(odd.RANKS)
    return ranks, tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_ids_are_those_of_the_library():
    ranks, library = own_tiktoken()
    codec = byte_bpe.TextCodec(ranks, public_tokenizers.PATTERN)
    texts = [t for _, t in odd.texts()] + random_texts(4000) + every_character()
    texts += ["a" * 4000, "ab" * 4000, "的" * 3000, "=-" * 3000]
    for text in texts:
        ids = codec.encode(text)
        assert ids == ",".join(map(str, library.encode_ordinary(text)))
        assert codec.decode(ids) == text.encode()


def test_backtracking_alone_gives_the_merges():
    ranks, library = own_tiktoken()
    encoder = byte_bpe.Encoder(ranks)
    for word in ("retitioning", "unbelievabletheirs", "aaaaaaabaaaa", "éèüñéèüñ"):
        assert encoder._backtracked(word.encode().decode("latin-1")) == library.encode_ordinary(word)


def test_encoded_column_and_round_trip(spark):
    _, library = own_tiktoken()
    made = byte_bpe.encoded(spark, F.col("text"), odd.RANKS, public_tokenizers.PATTERN, ids=True)
    rows = odd.table(spark).select("doc_id", "text", made.alias("m")).select("doc_id", "text", "m.*")
    back = rows.withColumn("back", byte_bpe.decoded(spark, F.col("ids"), odd.RANKS)).collect()
    assert len(back) == len(odd.ROWS)
    for r in back:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert bytes(r["back"]) == (r["text"] or "").encode()
    assert odd.table(spark, []).select(made).count() == 0


def test_counts_are_those_of_the_model(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=odd.PIECES)
    with open(odd.PIECES, "rb") as file:
        counts = piece_counts.Counts(file.read())
    texts = random_texts(4000) + every_character() + ["", " ", "  ", "\n", "▁", " ▁ a"]
    assert counts.of(texts) == [len(i) for i in model.encode(texts)]
    column = piece_counts.token_counts(spark, F.col("text"), odd.PIECES)
    for text, n in odd.table(spark).select("text", column).collect():
        assert n == len(model.encode(text or ""))
    assert odd.table(spark, []).select(column).count() == 0


def brute_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_rules_are_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(150):
        capacity = rnd.choice([7, 10, 64, 100, 128])
        lengths = [rnd.choice([rnd.randint(1, capacity), capacity // 2, capacity // 3]) for _ in range(rnd.randint(0, 150))]
        bins, placed = defaultdict(list), Counter()
        for length, first, last, sequence, copies, offset in packing.best_fit(Counter(lengths), capacity):
            for n in range(first, last):
                bins[sequence + (n - first) // copies].append((offset + (n - first) % copies * length, length))
                placed[length] += 1
        assert placed == Counter(lengths)
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
        assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == brute_best_fit(lengths, capacity)


def test_ids_of_packing_are_those_of_the_tokenizer():
    library = Tokenizer.from_file(odd.BYTE_BPE)
    with open(odd.BYTE_BPE) as file:
        ids = packing.Ids(file.read())
    texts = random_texts(3000) + every_character() + ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n"]
    for text, found in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids.encode(text) == np.array(found.ids, "<u4").tobytes()


def test_packing_whole_documents(spark):
    library = Tokenizer.from_file(odd.BYTE_BPE)
    capacity = 64
    packed = packing.pack(odd.table(spark), odd.BYTE_BPE, 2, capacity, with_ids=True)
    rows = packed.collect()
    documents = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids + [2])) for i, t in odd.texts())
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in documents.items())
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in rows) == Counter(
        (i, start, ids[start:stop])
        for (i, ids), n in documents.items()
        for _ in range(n)
        for start, stop in cuts(len(ids), capacity)
    )
    filled = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == binascii.crc32(np.array(r["ids"], "<u4").tobytes())
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
    assert sorted(capacity - sum(n for _, n in own) for own in filled.values()) == brute_best_fit(
        [r["length"] for r in rows], capacity
    )
    whole = packing.sequences(packed).collect()
    assert {len(r["ids"]) for r in whole} <= set(range(capacity + 1)) and len(whole) == len(filled)
    assert packing.pack(odd.table(spark, []), odd.BYTE_BPE).count() == 0


def cuts(size, capacity):
    first = (size - 1) % capacity + 1
    edges = [0, *range(first, size + 1, capacity)]
    return list(zip(edges, edges[1:]))
