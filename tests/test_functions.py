import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import hashing
from loomgraph.functions import text as T
from loomgraph.operators import embed, tokenize
from loomgraph.operators.tokenize import Bpe


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("", "cbf29ce484222325"), ("hello", "a430d84680aabd0b"), ("é漢😀", "03250004b00d5962")])
def test_fnv(spark, text, want):
    assert one(spark, "s string", (text,), hashing.hash_content(F.col("s"))) == want
    assert one(spark, "s string", (text,), hashing.hash_content_native(F.col("s"))) == want


def test_hash_file_depends_on_path(spark):
    df = spark.createDataFrame([("a.ts", "x"), ("b.ts", "x")], "p string, c string").select(hashing.hash_file(F.col("p"), F.col("c")).alias("h"))
    a, b = (r["h"] for r in df.collect())
    assert a == "52bdd122d81d490f" and a != b


@given(st.text(max_size=60))
@settings(max_examples=200)
def test_fnv_is_64_bits(text):
    assert len(hashing.fnv1a(text.encode("utf-8", "surrogatepass"))) == 16


def test_languages(spark):
    paths = {"a.TS": "typescript", "x.d.ts": "typescript", "x.h": "c", "Makefile": None, "py": "python"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["l"] for r in df.select("p", T.detect_language(F.col("p")).alias("l")).collect()} == paths


def test_identifiers(spark):
    assert one(spark, "s string", ("doLoginHTTPServer_v2-x",), T.identifier_tokens(F.col("s"))) == ["do", "login", "h", "t", "t", "p", "server", "v2", "x"]


@pytest.mark.parametrize("n,want", [(0, []), (512, [(0, 512)]), (513, [(0, 512), (448, 513)]), (1000, [(0, 512), (448, 960), (896, 1000)])])
def test_chunks(spark, n, want):
    got = one(spark, "s string", (" ".join(f"w{i}" for i in range(n)),), T.chunks(F.col("s")))
    assert [(c["start_word"], c["end_word"]) for c in got] == want


def test_chunk_texts_and_bounds(spark):
    got = one(spark, "s string", ("a b c d e",), T.chunks(F.col("s"), 3, 1))
    assert [c["text"] for c in got] == ["a b c", "c d e"]
    with pytest.raises(ValueError):
        T.chunks(F.col("s"), 3, 3)


def test_bpe():
    bpe = Bpe({"low": 1, "er": 2, "[UNK]": 0}, ["l o", "lo w", "e r"])
    assert bpe.tokens("lower low") == ["low", "er", "low"]
    assert bpe.encode("lower low xyz", 4) == [1, 2, 1, 0]
    framed = Bpe({"low": 1, "er": 2, "<s>": 5, "</s>": 6}, ["l o", "lo w", "e r"], special={"cls": 5, "sep": 6})
    assert framed.encode("low low low", 4) == [5, 1, 1, 6]


def test_byte_level_bpe_matches_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe, lib = Bpe.load(path, byte_level=True), Tokenizer.from_file(path)
    for word in ("hello", "éclair", "tokenizer", "漢字"):
        assert [bpe.vocab[t] for t in bpe.tokens(word)] == lib.encode(word, add_special_tokens=False).ids


def test_padding(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (1, [4])], "b int, input_ids array<int>")
    out = {tuple(r["input_ids"]): r["attention_mask"] for r in tokenize.pad_batch(df, F.col("b"), pad=9).collect()}
    assert out == {(1, 2, 3): [1, 1, 1], (4, 9, 9): [1, 0, 0]}


def test_embedding_has_unit_length(spark):
    nodes = spark.createDataFrame([("a", "File", "n", "some words here"), ("b", None, None, None)], "id string, label string, name string, content string")
    out = embed.embed_chunks(embed.chunk_nodes(nodes), embed.hashed_model(16)).collect()
    assert len(out) == 2 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in out)
