"""A table with every awkward case, and the public vocabularies."""

import public_tokenizers

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

SHARED = "This very common line stands in many documents"
LONG = " ".join(f"word{i % 997} und{i}" for i in range(20_000)) + "\n" + "x" * 5000

ROWS = [
    (None, None, None),
    (None, "no id, but a text of its own", "en"),
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t\n", "de"),
    (4, "12345 !!! 678", None),
    (5, LONG, "en"),
    (6, "the same text in two rows", "en"),
    (6, "the same text in two rows", "en"),
    (7, "the same text in two rows", "en"),
    (8, f"First\n  {SHARED.upper()} \nlast", "fr"),
    (9, f"{SHARED}\n{SHARED}", "fr"),
    (10, f"other\n{SHARED}\t", "de"),
    (11, "ça va bien \U0001f600 é 中文 <|endoftext|> <s>", "fr"),
    (12, "\x00\x1c 　▁ ▁", "es"),
    (12, "another text under a repeated id", "es"),
]

#: Names that operators use themselves.
CLASHES = "size shard slot score lang_pred length piece id text_hash lines lost kept component_id rows part fingerprint".split()


def table(spark, rows=ROWS):
    extra = ", ".join(f"{c} string" for c in CLASHES)
    schema = f"doc_id bigint, text string, lang string, n_chars bigint, {extra}"
    full = [r + (len(r[1] or ""),) + ("clash",) * len(CLASHES) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def texts(rows=ROWS):
    return [(i, t or "") for i, t, _ in rows]
