"""Extra columns that are named like outputs or inner columns change no result."""

import corpus_pipeline as P
import pytest
from plumbline.llm import bpe, chat, decontam, fim, langid, linedup, lm, quality, queries, repeats, secrets, simhash
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = """_at _body _c _doc _end _gone _h1 _id _keep _last _lines _order _place _row _secret _start _text _words a at b base_failed base_score block blob c component_id contaminated
 decoded end exact fp g ids items kept kind lang_pred least len n n_chunks_removed n_hit n_near n_tokens n_words near off p pid pos postings prefix_chars middle_chars output form _key _hot _parts _part _null rejected_by root score spans start term train train_tokens w wins words""".split()
ITEMS = [("i", "b c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.documents(), SCHEMA).cache()


@pytest.fixture(scope="module")
def odd(docs):
    return docs.select("*", *[F.lit("own").alias(n) for n in NAMES]).cache()


def items(df):
    return df.sparkSession.createDataFrame([(*i, 0, 0) for i in ITEMS], "item_id string, text string, term int, _row int")


USES = {
    "bpe": lambda d: bpe.digests(bpe.encode_decode(d, queries.TOKENIZER)),
    "quality": lambda d: quality.quality(d).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept"),
    "simhash": lambda d: simhash.near_duplicates(d),
    "deduplicate": lambda d: simhash.deduplicate(d).select("doc_id", "text"),
    "secrets": lambda d: secrets.digests(secrets.scan(d)),
    "langid": lambda d: langid.identify(d),
    "langid_kept": lambda d: langid.predict(d, langid.fit(d, ~langid.held_out(F.col("doc_id"))), d.columns).select("doc_id", "lang_pred", "score"),
    "repeats": lambda d: repeats.remove_repeats(d),
    "decontam": lambda d: decontam.digests(decontam.judged(d, items(d))),
    "linedup": lambda d: linedup.dedup_lines(d).select("doc_id", "text", "n_chunks_removed"),
    "fim": lambda d: fim.digests(fim.transform(d)),
    "lm": lambda d: lm.score(d, F.col("doc_id") > 3).select("doc_id", "n_tokens", "n_known", F.round("score", 6).alias("score")),
}


@pytest.mark.parametrize("name", list(USES))
def test_operator(docs, odd, name):
    plain, clashing = ([repr(r) for r in USES[name](d).collect()] for d in (docs, odd))
    assert sorted(plain) == sorted(clashing)


def test_own_columns_stay(odd):
    for out in (secrets.scan(odd), linedup.dedup_lines(odd), simhash.deduplicate(odd), decontam.judged(odd, items(odd))):
        r = out.first()
        assert r["_id"] == r["_start"] == r["near"] == r["g"] == "own"


@pytest.mark.parametrize("name, stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stage(spark, tmp_path, docs, odd, name, stage):
    items(docs).write.parquet(f"{tmp_path}/benchmark.parquet")
    plain, clashing = stage(spark, docs, str(tmp_path)), stage(spark, odd, str(tmp_path))
    if stage is not P.STAGES[-1][1]:
        assert clashing.columns == odd.columns and clashing.filter("_id <> 'own' or score <> 'own' or items <> 'own'").count() == 0
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, clashing.select(*plain.columns).collect()))


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = df.select("*", *[F.lit("own").alias(n) for n in [*NAMES, "content", "layout", "formatted", "parts", "messages"]])
    got = [sorted(repr(tuple(r)) for r in chat.digests(chat.format_parts(chat.canonical_turns(d))).collect()) for d in (df, more)]
    assert got[0] == got[1] and len(got[0]) == 2
