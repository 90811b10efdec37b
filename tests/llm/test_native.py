"""BPE, quality rules, secrets and chat formatting against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from plumbline.llm import bpe, chat, quality, queries, secrets

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.documents(), SCHEMA)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_bpe_as_the_library(spark, docs):
    from tokenizers import Tokenizer

    rows = brute.documents() + [(900, "x <|endoftext|> y<|endoftext|>", None, None, None), (901, "<|endoftext|>" * 3000 + "z" * 20_000, None, None, None)]
    tok = Tokenizer.from_file(queries.TOKENIZER)
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), brute.sha(",".join(map(str, ids))), brute.sha(tok.decode(ids, skip_special_tokens=False))))
    got = bpe.digests(bpe.encode_decode(spark.createDataFrame(rows, SCHEMA), queries.TOKENIZER)).collect()
    same(map(tuple, got), want)
    two = bpe.decode(bpe.encode(docs, queries.TOKENIZER), queries.TOKENIZER).select("text", "decoded").collect()
    assert all((a or "") == b for a, b in two)


def test_bpe_tree_is_exact():
    c = bpe.Codec(queries.TOKENIZER, leaf=7)
    r = random.Random(1)
    for n in (1, 7, 8, 50, 333, 2000):
        for letters in ("a", "ab", "etaoinsh", "é日a😀", "0123456789"):
            t = "".join(r.choice(letters) for _ in range(n))
            assert c.tree(t.encode()) == c._bpe._encode_single_piece(t.encode())
            u = t + "  \n " + t + " x" + t
            assert c.encode(u) == c._bpe.encode_ordinary(u)


def test_quality(spark, docs):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality.quality(docs)
    same(map(tuple, out.select(*cols).collect()), [(r[0], *brute.quality(r[1])) for r in brute.documents()])
    assert out.filter("kept and base_failed").count() == 0 and out.filter("kept").count() > 30
    other = quality.cascade(quality.measured(docs), quality.default_rules()[::-1]).filter("rejected_by is null").count()
    assert other == out.filter("rejected_by is null").count()
    assert quality.quality(docs.limit(0)).count() == 0


def test_secrets(spark, docs):
    got = secrets.digests(secrets.scan(docs)).collect()
    same([tuple(r)[:5] for r in got], [(r[0], *brute.secrets(r[1])) for r in brute.documents()])
    by = {r["doc_id"]: r["spans"] for r in got if r["spans"]}
    kinds = [sorted(x.split(":")[0] for x in s.split(",")) for s in by.values()]
    assert any({"user", "key", "endpoint"} <= set(k) for k in kinds)
    alone = next(r for r in brute.documents() if r[1] and r[1].endswith("alone"))
    assert alone[0] not in by
    assert secrets.scan(docs.limit(0)).count() == 0


def test_linked_spans(spark, docs):
    key, hexa = "aB3d" * 10, "deadbeef" * 4
    texts = [f"account: {key}", f"account: joe {key}", f"{key}", f"user=joe https://h.example/p", f"user=joe {'x ' * 190}{hexa}", f"user=joe {'x ' * 200}{hexa}"]
    texts += [f"{hexa}{' y' * 300} user=joe", f"https://h.example/p AKIA{'QX7Z' * 4} {key}", f"{key} login: token=abcdef12", f"k {'aB3' * 60} AKIA{'QX7Z' * 4}"]
    texts += ["password=abc", "x" * 40, *[r[1] for r in brute.documents()]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in secrets.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(a, b, k) for a, _, b, k in brute.all_spans(t)], t
    assert got[0] == [] and len(got[1]) == 2 and got[2] == [] and got[3] == []


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\[INST] ok \\\\</s> <s>[/INST]"), (1, 1, "assistant", "a"), (2, 0, None, None), (None, 3, "assistant", "x\\"), (3, 0, "[INST]", " </s>"), (3, None, "user", "")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"é😀{i}") for i in range(200)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, extra int")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_parts(chat.canonical_turns(df))).collect()}
    for k in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == k))
        loss = [x for _, r, x in turns if r == "assistant"]
        assert got[k] == (len(turns), brute.sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), sum(map(len, loss)), brute.sha("".join(loss)))
    assert chat.digests(chat.format_parts(chat.canonical_turns(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    import json

    recs = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 5},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "completion": "b", "score": {"x": [1]}},
        {"instruction": "a", "output": "b"},
        {"instruction": "a", "input": "c", "output": "b"},
        {"question": "a", "answer": "b"},
        {"other": 1},
        {"system": "s", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "tool_calls": [{"f": {"x": 1}}]}], "a b": {"c.d": []}, "conv_id": 77},
        {"text": "t", "prompt": "a", "completion": "b"},
        {"messages": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)] + [(20, "not json"), (21, None)], "id long, rec string")
    got = brute.grouped(chat.json_turns(df, "rec", "id").orderBy("conv_id", "turn").collect(), "conv_id")
    two = [("user", "a"), ("assistant", "b")]
    for i in range(6):
        assert [(r["role"], r["text"]) for r in got[i]] == (two if i != 4 else [("user", "a"), ("user", "c"), ("assistant", "b")])
    assert [r["layout"] for k in (6, 9, 20, 21) for r in got[k]] == [None] * 4
    assert [(r["layout"], r["turn"], r["role"], r["text"]) for r in got[77]] == [("system_messages", i, *x) for i, x in enumerate([("system", "s"), *two])]
    assert [(r["layout"], r["role"], r["text"]) for r in got[8]] == [("prompt", *x) for x in two]
    nested = spark.createDataFrame([('{"b": {"x": [[1, {"y`z": 2}]], "q": {}}, "a": null, "m": [{"r": 1}, {"s": [2]}]}',)], "j string")
    assert nested.select(chat.field_paths(F.try_parse_json("j")).alias("p")).first()["p"] == ["a", "b.x[][]", "m[].r", "m[].s[]"]
    mixed = spark.createDataFrame([("a", "b", 5)], "prompt string, completion string, conv_id long")
    assert [tuple(r) for r in chat.canonical_turns(mixed).collect()] == [(5, 0, "user", "a"), (5, 1, "assistant", "b")]
    assert chat.canonical_turns(spark.createDataFrame([("a", "b", 3)], "prompt string, completion string, z int")).count() == 2
