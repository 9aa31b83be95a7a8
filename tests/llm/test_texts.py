"""Token counts, pieces and secrets against the libraries and brute force."""

import hashlib
import random
import re
import string

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from textloom.llm import secrets  # noqa: E402
from textloom.llm.pieces import PieceCodec, encode_texts  # noqa: E402
from textloom.llm.token_counts import MergeCounter, token_counts  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b ", "\n\t\r\n", "don't we'll I'VE", "<|endoftext|>x<|endoftext|>", "<s></s><unk><0x41>", "▁▁ ▁a", "日本語 текст é é", "\U0001f600\U0001f468‍\U0001f469", "a" * 5000, "x\u0000y", "1234 56.7", "'" * 50, "é" * 999 + " end"]


def fuzz(n, seed):
    rng = random.Random(seed)
    alphabet = [*" ▁ab<>s0x4\n\t éß日\U0001f600\x00‍'’|!", "<|endoftext|>", "<s>", "  ", "the ", "ing", " ", "\x1c", "\x85", " "]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(n)]


def test_counts_equal_library():
    library, counter = Tokenizer.from_file(BPE), MergeCounter(BPE)
    for text in [t or "" for t in ODD] + fuzz(3000, 1):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_split_knows_every_character():
    """One text for each block of code points; a difference in any class shows as a difference in counts."""
    library, counter = Tokenizer.from_file(BPE), MergeCounter(BPE)
    for low in range(0, 0x110000, 512):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(low, low + 512) if not 0xD800 <= c < 0xE000)
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(low)


def test_token_query(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "a b", "x"), (1, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(BPE)
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, BPE, limit=600).collect())
    want = sorted((k is None, k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 600) for k, t, _ in rows)
    assert got == want
    assert token_counts(df.limit(0), BPE).count() == 0


def test_pieces_equal_library():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceCodec(PIECES)
    for text in [t or "" for t in ODD] + fuzz(3000, 2) + [" " * n for n in range(20)]:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == library.decode(ids), repr(text)
    assert codec.wrong() == set()


def test_decoding_any_ids():
    library, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceCodec(PIECES), random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([1, 2, rng.randint(3, 258), rng.randint(259, 31999), 259, 260]) for _ in range(rng.randint(0, 6))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_a_wrong_segment_is_noticed():
    codec = PieceCodec(PIECES)
    codec.packed("some words")
    codec.fresh["▁words"] = b"\x05\0\0\0"
    assert codec.wrong() == {"▁words"}


def test_pieces_query(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "a b")]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, with_ids=True).collect()}
    for k, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[k].ids == ids and got[k].verified and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def brute_spans(text):
    """The rules spelled out: leftmost matches first, then the short ones dropped."""
    found = []
    for k, (pattern, flags) in enumerate(
        [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), (r"AKIA[A-Z0-9]+", 0), (r"[0-9a-f]+", 0)]
    ):
        for m in re.finditer(pattern, text, flags):
            if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans():
    rng = random.Random(4)
    parts = ["password", "Api_Key", "APIKEY", "ſecret", "toKen", ":", " = ", "'", '"', "AKIA", "AKIA" + "Z9" * 9, "0af" * 9, "abc123", "xyz", " ", "é", "g", "=", "--"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 8)))
        assert secrets.base_spans(text) == brute_spans(text), text


def test_random_tokens():
    rng = random.Random(5)
    hits = 0
    for _ in range(200):
        token = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
        hits += bool(secrets.random_spans(f"the key {token} here"))
    assert hits >= 190
    for plain in ("ThisIsALongCamelCaseIdentifierName2", "some-long-url-slug-with-words-2024-and-more", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "version_2_3_4_release_candidate", "1234567890123456789012345"):
        assert secrets.random_spans(f"see {plain} there") == []


def test_random_values_after_equals_signs():
    for before, token, after in (
        ("AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMI7K4MDENGbPxRfiCYz9aQ3kLm2Tv", "\n"),
        ("see https://x.org/get?sig=", "Zk3Jd82hGq7Lm1Xp9Rt5Vw", "&se=2024"),
        ("k=", "Zk3Jd82hGq7Lm1Xp9Rt5Vw==", " "),
        ("a ==", "Zk3Jd82hGq7Lm1Xp9Rt5Vw", ";"),
    ):
        assert secrets.random_spans(before + token + after) == [(len(before), len(before) + len(token))]
        assert secrets.redact(before + token + after) == before + "[SECRET]" + after
    assert secrets.random_spans("LONG_SETTING_NAME_2=some-long-value-of-words-2024 and ?page=the-second-part-of-the-story-2") == []


def test_random_values_in_json_and_paths():
    token = "Zk3Jd82hGq7Lm1Xp9Rt5VwYb6N"
    for before, after in (('{"auth": "', '"}'), ("https://x.org/key/", "/"), ("blob/main/", " and"), ("('", "')")):
        assert secrets.random_spans(before + token + after)[0][0] == len(before)
    # Tokens of the base patterns are no part of the family.
    base = secrets.base_spans(f"token={token} and {token[::-1]}")
    assert secrets.random_spans(f"token={token} and {token[::-1]}", base) == [(len(token) + 11, 2 * len(token) + 11)]


def slow_random_spans(text):
    """The rules spelled out over all candidates of a text: weighted steps, without sorting tricks."""
    held = []
    for start, end, token in secrets.candidates(text):
        if not any(start < b and a < end for a, _, b in brute_spans(text)):
            found = secrets.infer_encoding(token)
            p = 1.0 if found is None or token.isdigit() else secrets.wordlikeness(token, found[0])
            r = 0.0 if found is None or token.isdigit() else secrets.randomness(token, found[1])
            held.append((p, len(token), min(1.0, r / 0.03) ** 4, start, end))
    if not held:
        return []
    mean = sum(n for _, n, _, _, _ in held) / len(held)
    weighted = [(p / (n / mean * w) if w else float("inf"), s, e) for p, n, w, s, e in held]
    steps = [k for k in range(1, len(held) + 1) if sum(p <= 1e-4 * k / len(held) for p, _, _ in weighted) >= k]
    return sorted((s, e) for p, s, e in weighted if steps and p <= 1e-4 * max(steps) / len(held))


def test_random_spans_equal_brute_force():
    rng = random.Random(11)
    parts = ["SomeLongIdentifierName", "a_setting_of_words_only", "token = ", "key/", "=", " ", ". "]
    for _ in range(300):
        text = " ".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(14, 45))) for _ in range(6))
        assert secrets.random_spans(text, secrets.base_spans(text)) == slow_random_spans(text), text


def test_random_tokens_of_letters_only():
    rng = random.Random(7)
    tokens = ["".join(rng.choices(string.ascii_letters, k=40)) for _ in range(200)]
    assert sum(bool(secrets.random_spans(f"the key {t} here")) for t in tokens) >= 170
    for plain in ("ArrayIndexOutOfBoundsException", "AddWavesToBoxPlot", "GetEntSendPropOffs", "HTTPSConnectionPoolManager", "INTERNATIONALIZATION", "Donaudampfschifffahrtsgesellschaft", "incomprehensibilities"):
        assert secrets.random_spans(f"see {plain} there") == []


def test_secret_query_and_redaction(spark):
    key = "Zk3TqP9xWv7RmB2nLd8YhC5sGf4JtQ6aEu1KoXi0"
    rows = [(1, "token = 'abcdef12' and AKIA" + "A1" * 8, "e"), (2, None, "e"), (3, "", "e"), (None, f"x {key} y", "e"), (4, "plain words", "e"), (4, "plain words", "e")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in secrets.secret_scan(df).collect()}
    assert got[1].spans == "assign:0:17,access:23:43" and (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 0)
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert got[2].spans == got[3].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].spans == f"random:2:{2 + len(key)}" and got[None].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = {r.doc_id: r for r in secrets.redact_secrets(df).collect()}
    assert out[1].text == "[SECRET]' and [SECRET]" and out[1].n_chars == 22 and out[2].text is None and out[2].n_chars == 7
    assert secrets.redact_secrets(df).columns == df.columns
