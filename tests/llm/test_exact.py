"""Operators whose results are exact: against SQL, a brute-force version, or a round trip."""

import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
import xxhash
from oracle import connect, rows
from pyspark.sql import functions as F

from loomgraph.llm import chat, exact_dedup, mixing, queries, simhash, suffix_dedup, token_ids, warc

DIR = "/root/testdata/sf0.001"
ODD = [(1, "a b\tc"), (2, "abc"), (2, "abc"), (None, "abc "), (3, None), (4, ""), (5, "x" * 3000), (6, "ab " * 80), (7, "ab " * 90), (None, None)]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, uid long, fp string, size int"


def odd(spark):
    return spark.createDataFrame([(i, t, None, s, None, 9, "z", 1) for (i, t), s in zip(ODD, [None, "a", "a", "b", None, "", "b", "c", "c", None])], EXTRA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), connect(DIR).sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("seed", range(5))
def test_rice_round_trip(seed):
    dice = np.random.default_rng(seed)
    values = np.unique(dice.integers(0, 1 << 40, dice.integers(1, 500), dtype=np.uint64))
    k, payload = exact_dedup.rice_encode(values, 1 << 40)
    assert (exact_dedup.rice_decode(len(values), k, payload) == values).all()
    assert len(payload) < 8 * len(values) + 8


def test_exact_dedup_of_odd_rows(spark):
    plain = exact_dedup.exact_dedup(odd(spark)).toPandas()
    forced = exact_dedup.exact_dedup(odd(spark), digest_bytes=1, bits=16).toPandas()  # collisions, told apart by bytes
    assert rows(plain) == rows(forced) and len(plain) == len(ODD)
    abc = plain[plain["text_sha256"] == hashlib.sha256(b"abc").hexdigest()]
    assert set(abc["keep_id"]) == {1} and set(abc["group_size"]) == {4} and abc["kept"].sum() == 1
    assert exact_dedup.exact_dedup(odd(spark).limit(0)).count() == 0


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd(spark)).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 2 * got["size"]).all()
    assert mixing.mix(odd(spark).limit(0)).count() == 0


def test_targets_by_resharing(spark):
    sizes = [100, 5, 900, 40, 40, 7, 300]
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.source_targets(df).orderBy("source").collect()]
    s, w = np.array(sizes, float), np.array([[5, 2, 1][i % 3] for i in range(len(sizes))], float)
    full = np.zeros(len(s), bool)
    while True:
        level = (1.5 * s.sum() - 2 * s[full].sum()) / w[~full].sum()
        want = np.where(full, 2 * s, w * level)
        if not (over := (want > 2 * s + 1e-9) & ~full).any():
            break
        full |= over
    assert np.allclose(got, want)


def test_chat_round_trip(spark):
    texts = ["</s>[INST] &lt; <+> [/ROLE]", "&amp;lb;", "", None, "a\nb"]
    turns = [(1, i, r, x) for i, (r, x) in enumerate(zip(["user", "user", "assistant", "assistant", None], texts))] + [(2, 0, "system", "[ROLE]"), (2, 0, "system", "[ROLE]")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert back[1] == [(r or "", x or "") for _, _, r, x in turns[:5]] and back[2] == [("system", "[ROLE]")] * 2
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_warc_links(spark):
    html = '<html lang="fr"><title>A &amp; B</title><script>x<p></script><p>one<br>two <a href="/x">l</a><!-- c --></html>'
    pages = spark.createDataFrame([(1, "http://a/b", html, 3), (2, None, None, 3), (2, None, None, 3)], "page_id long, url string, html string, record int")
    made = warc.derive(warc.pages_to_responses(pages)).collect()
    assert len(made) == 6
    by_kind = {r["record_type"]: warc.read_record(bytes(r["record"])) for r in made if r["page_id"] == "1"}
    response = warc.read_record(warc.response_record("1", "http://a/b", html))[0]
    for fields, block in by_kind.values():
        assert fields["warc-refers-to"] == response["warc-record-id"] and fields["warc-target-uri"] == "http://a/b"
        assert fields["warc-source-payload-digest"] == response["warc-payload-digest"] and fields["warc-block-digest"] == warc.digest(block)
    assert by_kind["conversion"][1].decode() == "A & B\none\ntwo l"
    assert b"outlink: /x" in by_kind["metadata"][1]
    with pytest.raises(ValueError):
        warc.derive_record(b"junk")
    assert warc.digests(warc.derive(warc.pages_to_responses(pages.limit(0)))).count() == 0
    assert warc.derive(spark.createDataFrame([("1", b"junk")], "page_id string, record binary")).first()["record_type"] == "invalid"


def brute_prints(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def joined(values, close):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if close(values[i], values[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_dedup(docs).collect()}
    ids, texts = zip(*sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    prints = [brute_prints(t) for t in texts]
    roots = joined(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    for i, doc in enumerate(ids):
        assert (int(got[doc]["fingerprint"], 16), got[doc]["component_id"]) == (prints[i], ids[roots[i]])


def test_gray_tree_and_crowded_links(spark):
    dice = np.random.default_rng(1)
    base = dice.integers(0, 1 << 64, 40, dtype=np.uint64)
    flip = lambda: np.uint64(1) << dice.integers(0, 64, len(base), dtype=np.uint64)
    crowd = np.uint64(0xABCD << 48) | dice.integers(0, 64, 60, dtype=np.uint64)  # one front, many neighbours
    x = np.unique(np.concatenate([base, base ^ flip(), base ^ flip() ^ flip(), base ^ flip() ^ flip() ^ flip(), crowd]))
    tree = simhash.GrayTree(x)
    q, p = tree.search(x)
    assert set(zip(x[q].tolist(), tree.prints[p].tolist())) == {(a, b) for a in x.tolist() for b in x.tolist() if (a ^ b).bit_count() <= 2}
    links = simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"), group_rows=8)
    got = {r["id"]: r["root"] for r in simhash.components(links).collect()}
    ids = sorted(x.view(np.int64).tolist())
    roots = joined([i % (1 << 64) for i in ids], lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got.get(i, i) for i in ids] == [ids[r] for r in roots]


def test_simhash_of_odd_rows(spark):
    got = simhash.near_dedup(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["fingerprint"] for r in got if r["doc_id"] in (3, 4)} == {"0" * 16}
    assert simhash.near_dedup(odd(spark).limit(0)).count() == 0


def test_near_groups_join_near_copies_alone(spark):
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(7))
    docs, want = [], {}
    for g in range(12):
        text = [word() for _ in range(300)]
        for c in range(3):
            copy = list(text)
            for i in dice.sample(range(300), 2 * c):
                copy[i] = word()
            want[len(docs)] = 3 * g
            docs.append((len(docs), " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), group_rows=8).collect()}
    assert got == want


def test_near_groups_at_the_threshold_against_brute_force(spark):
    dice = random.Random(11)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(7))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(dice.choice([60, 150, 400]))]
        texts.append(base)
        for share in (0.012, 0.018, 0.022, 0.03):
            copy = list(base)
            for i in dice.sample(range(len(base)), round(len(base) * share)):
                copy[i] = word()
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = joined(list(range(len(rows))), near)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [int(w) for w in want]


def test_near_groups_by_kind_of_edit_and_in_a_dense_group(spark):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 9)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(dice.choice([60, 150, 400]))]
        n = len(base)
        short, at = list(base), dice.randrange(n // 2)
        for i in dice.sample(range(n), 2):
            short[i] = word()
        new = [word() for _ in range(n // 11)]
        texts += [base, base + [word() for _ in range(n // 5)], base[: n - n * 15 // 100], base + [word() for _ in range(n // 10)], short]
        texts += [base[:at] + new + base[at + len(new) :], base[:at] + base[at + n * 15 // 100 :]]
    base = [word() for _ in range(120)]
    for _ in range(70):  # pairs on both sides of the threshold
        copy = list(base)
        for i in dice.sample(range(120), dice.randint(1, 5)):
            copy[i] = word()
        texts.append(copy)
    texts += [["four", "words", "and", c] for c in "xyz"] + [["a", "b", "c"]] * 2 + [[], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = joined(list(range(len(rows))), near)
    for turns in (0, 2):
        docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "uid long, doc_id long, text string")
        got = {r["doc_id"]: (r["component_id"], r["keep"]) for r in simhash.near_rows(docs, "uid", turns=turns).collect()}
        assert [got[i] for i in range(len(rows))] == [(int(w), int(w)) for w in want]


def test_near_groups_of_odd_rows(spark):
    got = simhash.near_groups(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}
    assert sorted(r["component_id"] for r in got if r["doc_id"] is None) == [2, 3]
    assert simhash.near_groups(odd(spark).limit(0)).count() == 0


def brute_strip(texts):
    seen, out = {}, []
    for d, x in enumerate(texts):
        for i in range(len(x) - 99):
            seen.setdefault(x[i : i + 100], (d, i))
    for d, x in enumerate(texts):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 99):
            if seen[x[i : i + 100]] != (d, i):
                gone[i : i + 100] = True
        out.append((len(x), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [1, 4000])
def test_strip_against_brute_force(spark, crowded, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.strip(docs).collect()}
    data = sorted((r["doc_id"], r["text"].encode()) for r in docs.collect())
    assert [got[i] for i, _ in data] == brute_strip([x for _, x in data])


def test_strip_of_odd_rows(spark):
    got = suffix_dedup.strip(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[7]["n_removed"] == 270 and by[6]["n_removed"] == 237 and by[5]["n_removed"] == 2999
    assert suffix_dedup.strip(odd(spark).limit(0)).count() == 0


def test_columnwise_bwt():
    dice = np.random.default_rng(0)
    pieces = [bytes(dice.integers(97, 100, dice.integers(1, 30)).astype(np.uint8)) for _ in range(50)] + [b"abcabc"] * 3
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = suffix_dedup.build_bwt(pieces, folder)
    suffixes = sorted((p[i:] + b"\0", k, i) for k, p in enumerate(pieces) for i in range(len(p) + 1))
    symbols = sorted(set(b"".join(pieces)))
    assert bwt.tolist() == [0 if i == 0 else symbols.index(pieces[k][i - 1]) + 1 for _, k, i in suffixes]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
            n += 1
        return n

    assert lcp.tolist() == [0] + [shared(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]


def test_token_ids_match_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    hard = ["That*** THND!! the, don,t .,, <|ENDOFTEXT|> É, İ, ﬁx. 's it 's <|endoftext|>x", "a\n\n b\t c\x1cd", "ΑΣ é ́x 漢字　x 😀👍🏽", "a" * 4000]
    docs = odd(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(hard, 100)), "doc_id long, text string"))
    got = token_ids.token_table(docs, path, shard_ids=200, bucket_keys=3).collect()
    want, start = [], 0
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is None, x[0]))
    by_id = {}
    for i, x in texts:
        by_id.setdefault(i, []).append(tokenizer.encode(x, add_special_tokens=False).ids + [1])
    for i, lists in by_id.items():
        for ids in sorted(lists, key=lambda v: np.array(v, "<u2").tobytes()):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_ids.token_table(docs.limit(0), path).count() == 0


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64))
    f = token_ids.PerfectHash(token_ids.PerfectHash.build(keys))
    assert sorted(f(keys).tolist()) == list(range(len(keys)))


def test_index_refuses_unknown_keys(spark):
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(300)], "doc_id long, text string")
    shards = token_ids.write_shards(docs, queries.tokenizer_path(), 50)
    stored = token_ids.stored_documents(shards)
    index, buckets = token_ids.build_index(stored, 300, 64)
    asked = token_ids.with_copy(spark.range(200, 1300).select(F.col("id").alias("doc_id")), "doc_id")
    found = {r["doc_id"] for r in token_ids.look_up(asked, index, buckets).collect()}
    assert set(range(200, 300)) <= found and len(found) <= 102


def test_rows_come_from_the_place_the_index_names(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y") for i in range(40)], "doc_id long, text string")
    shards = token_ids.write_shards(docs, queries.tokenizer_path(), 50)
    stored = token_ids.stored_documents(shards)
    read = lambda at: {r["doc_id"]: r["ids_crc32"] for r in token_ids.read_payloads(at, shards).collect()}
    right = read(stored)
    wrong = read(stored.withColumn("length", F.when(F.col("doc_id") == 7, F.col("length") - 1).otherwise(F.col("length"))))
    assert len(right) == 40 and [d for d in right if right[d] != wrong[d]] == [7]
    assert "Exchange" not in token_ids.read_payloads(stored, shards)._jdf.queryExecution().executedPlan().toString().split("FileScan")[-1]
