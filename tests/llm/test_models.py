"""Operators with Python in their tasks, against the libraries and brute force."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from logspar.llm import bpe, embedding_dedup, language_id, mixing, simhash, token_store

SCHEMA = "doc_id bigint, text string, source string, lang string, _extra string"
ODD = [None, "", " ", "don't STOP... we'll  see\n\n1234 ½ Ünïcode ñ é é ΑΣ İI ﬁ 你好 🙂", "<|endoftext|> x", "a\x1cb\x85c d", "z" * 3000, "the " * 4000 + "end", "\x00\x01 ​ tail "]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, f"s{i % 3}", "en", None) for i, t in enumerate(texts)], SCHEMA)


def table(spark, sf_dir, n=60):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()][:n]


@pytest.fixture(scope="module")
def reference_bpe():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, sf_dir, reference_bpe):
    texts = ODD + table(spark, sf_dir)
    made = bpe.encode_documents(docs(spark, texts), digests=True)
    back = {r.doc_id: r.decoded for r in bpe.decode_documents(made).collect()}
    for r in made.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == reference_bpe.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert bytes(back[r.doc_id]) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, [])).count() == 0


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    made = bpe.PerfectHash(keys)
    assert sorted(made.slot(k) for k in keys) == list(range(3000))
    assert all(made.order[made.slot(k)] == i for i, k in enumerate(keys))


def test_token_store(spark, sf_dir, tmp_path):
    texts = ODD + table(spark, sf_dir) + ["the " * 4000 + "end"]
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark, texts), path)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    want = [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    start = np.concatenate([[0], np.cumsum([len(x) for x in want])])
    rows = sorted(token_store.verify_documents(spark, path).collect())
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == [(i, start[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)]
    for r in token_store.read_documents(spark, path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    assert len(token_store.store_root(spark, path)) == 32
    chunks.limit(0).write.mode("overwrite").parquet(f"{path}-x/chunks")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{path}-x/recipes")
    with pytest.raises(Exception, match="can't be rebuilt"):
        token_store.verify_documents(spark, f"{path}-x").collect()
    token_store.write_store(docs(spark, []), f"{path}-none")
    assert token_store.verify_documents(spark, f"{path}-none").count() == 0


def test_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark, [f"text {i}" for i in range(40)]), path)
    assert token_store.verify_documents(spark, path).count() == token_store.read_documents(spark, path).count() == 40
    recipes = spark.read.parquet(f"{path}/recipes")
    for name, kept in (("row", recipes.filter("doc_id <> 7")), ("part", recipes.filter("doc_id > 15")), ("none", recipes.limit(0))):
        kept.write.parquet(f"{path}-{name}/recipes")
        for folder in ("chunks", "manifest"):
            spark.read.parquet(f"{path}/{folder}").write.parquet(f"{path}-{name}/{folder}")
        for read in (token_store.verify_documents, token_store.read_documents):
            with pytest.raises(Exception, match="differ from it"):
                read(spark, f"{path}-{name}").collect()


def test_words_and_rules():
    """Encoding by words equals the library's; a file with other rules has whole texts encoded."""
    own, whole = token_store.WordEncoder(token_store.VOCABULARY), Tokenizer.from_file(token_store.VOCABULARY)
    whole.encode_special_tokens = True
    texts = ODD + ["Straße, Éire! naïve? 'tis don't o'clock x's U.S. a1b2 ŉ ǅ ẞ İzmir Ω ﬃ e\u0301 \u0301a a\u0301. ß. ... ! ?!", "fresh words here; Fresh WORDS. here"]
    wanted = [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    read = lambda made: [np.frombuffer(x, "<u2").tolist() for x in made]
    assert own.by_word and read(map(own.encode, texts)) == wanted
    other = token_store.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert not other.by_word and read(map(other.encode, texts)) == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_added_tokens(spark, tmp_path):
    """Strings of added tokens: the library's default ids on request, as the query asks."""
    texts = ODD + ["a <|endoftext|> x", "<|EndOfText|>", "x<|startoftext|>y <|endoftext|><|endoftext|> z", "<| endoftext |>", "<|endoftext", "pipes <| and |> here", "<\u0338|endoftext|> \x1c <|endoftext|>"]
    whole = Tokenizer.from_file(token_store.VOCABULARY)
    want = [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    own = token_store.WordEncoder(token_store.VOCABULARY, plain=False)
    assert own.by_word and [np.frombuffer(own.encode(t), "<u2").tolist() for t in texts] == want
    assert 49407 in want[len(ODD)]
    docs(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    start = np.concatenate([[0], np.cumsum([len(x) for x in want])])
    rows = sorted(token_store.op3_token_store(spark, f"file://{tmp_path}").collect())
    assert [tuple(r)[:4] for r in rows] == [(i, start[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)]


def test_crc_join():
    a, b = b"abc" * 50, b"xyz" * 77
    assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    rng = random.Random(6)
    strings = [[rng.randbytes(rng.choice((1, 4, 700, 9000))) for _ in range(rng.randrange(1, 9))] for _ in range(40)]
    flat = [x for some in strings for x in some]
    start = np.cumsum([0, *map(len, strings[:-1])])
    made = token_store.crc_of_pieces(np.array([zlib.crc32(x) for x in flat]), np.array([len(x) for x in flat]), start)
    assert made.tolist() == [zlib.crc32(b"".join(x)) for x in strings]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprints():
    for text in ODD:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_links(values, near):
    least = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            m = min([least[j] for j in range(len(values)) if near(values[i], values[j])] + [least[i]])
            changed |= m != least[i]
            least[i] = m
    return least


def test_simhash_links(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(24), k=rng.randrange(6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(60)}
    fps |= {f ^ (1 << 63) ^ 1 for f in list(fps)[:10]} | {0}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= simhash.MAX_BITS for e in edges)
    joined = {frozenset((e.a, e.b)) for e in edges}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert brute_links(signed, near) == brute_links(signed, lambda a, b: frozenset((a, b)) in joined)


def test_simhash_documents(spark):
    texts = ODD + ["one two three four"] * 3 + ["ONE two\tthree four"]
    got = {r.doc_id: r for r in simhash.near_groups(docs(spark, texts)).collect()}
    want = brute_links([brute_fingerprint(t) for t in texts], lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got[i].component_id for i in range(len(texts))] == want
    left = simhash.drop_near_copies(docs(spark, texts))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want)) and left.columns == docs(spark, []).columns
    assert simhash.near_groups(docs(spark, [])).count() == 0


def test_language_id(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in rows.collect()}
    got = [r for r in language_id.identify(rows).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    model = language_id.fit(rows)
    names, scores = model.predict([None, "", "12 !?", *ODD[3:]])
    assert names[:3] == ["und"] * 3 and not scores[:3].any()
    alone = [model.predict([t])[1][0] for t in ODD]
    assert np.allclose(model.predict(ODD)[1], alone)
    assert language_id.fit(rows.limit(0)).predict(["abc"])[0] == ["und"]
    assert language_id.identify(rows.limit(0)).count() == 0
    assert sorted(r.doc_id for r in language_id.drop_unknown(docs(spark, ["the and of that", None, "123"]), model).collect()) == [0]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    vectors = [b + 0.06 * rng.standard_normal(16) for b in base for _ in range(4)] + [base[0] + 0.1 * rng.standard_normal(16) for _ in range(150)] + [base[1]] * 5 + [2 * base[1]]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2 if i < 60 else 0) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, rows[0][1], None), (n + 4, rows[0][1][:8], 0), (n + 5, [None] * 16, 0), (n + 6, [], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:n]])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
    want = brute_links(list(range(n)), lambda i, j: near[i, j])
    assert sum(got[i].component_id == w for i, w in enumerate(want)) >= 0.97 * n
    for i in range(n, n + 7):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_embedding_lone_pairs(spark, monkeypatch):
    """Pairs about a common mean, without other neighbours, in a part that few orders cannot do."""
    for name, value in (("SMALL", 500), ("ORDERS", 1), ("MOST_ORDERS", 1)):
        monkeypatch.setattr(embedding_dedup, name, value, raising=False)
    rng = np.random.default_rng(2)
    mean, off = rng.standard_normal(64), rng.standard_normal((1500, 64))
    first = 2.5 * mean / np.linalg.norm(mean) + off / np.linalg.norm(off, axis=1, keepdims=True)
    away = rng.standard_normal(first.shape)
    second = first + 0.17 * np.linalg.norm(first, axis=1, keepdims=True) * away / np.linalg.norm(away, axis=1, keepdims=True)
    x = np.concatenate([first, second])
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    assert near.sum() >= 2900
    assert sum(r.n_links for r in got) >= 0.97 * near.sum()
    assert all(r.n_links <= near[r.vec_id].sum() for r in got)
    assert sum(r.component_id == r.vec_id % 1500 for r in got) >= 0.97 * len(x)


def brute_bayes(labelled, texts):
    """Naive Bayes in plain Python: (label, probability) of each text."""

    def grams(text):
        low = "".join(c if ord(c) >= 0x10000 or c.isalpha() else " " for c in text.lower()) + "     "
        for order in language_id.ORDERS:
            for i in range(len(low) - 5 + 1):  # the blanks after a text start no n-gram of their own
                if i == len(low) - 5 or low[i : i + 2] == "  ":
                    continue
                h = order * 0x9E3779B1 & 0xFFFFFFFF
                for c in low[i : i + order]:
                    h = ((h ^ ord(c)) * 0x85EBCA6B) & 0xFFFFFFFF
                    h ^= h >> 13
                yield (h * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - language_id.BITS

    counts, n = {}, {}
    for text, label in labelled:
        if text is not None and label is not None and text:
            mine = counts.setdefault(label, {})
            n[label] = n.get(label, 0) + 1
            for g in grams(text):
                mine[g] = mine.get(g, 0) + 1
    size, half = 1 << language_id.BITS, language_id.SMOOTHING
    total = {x: sum(c.values()) + half * size for x, c in counts.items()}
    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            yield "und", 0.0
            continue
        found = list(grams(text))
        at = {x: math.log(n[x] / sum(n.values())) + sum(math.log((c.get(g, 0) + half) / total[x]) for g in found) for x, c in counts.items()}
        best = max(sorted(at), key=at.get)
        yield best, 1 / sum(math.exp(v - at[best]) for v in at.values())


def test_language_id_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    labelled = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    wanted = list(brute_bayes(labelled, [r.text for r in rows]))
    got = {r.doc_id: r for r in language_id.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for r, (lang, score) in zip(rows, wanted, strict=True):
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-6)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_of_long_texts(spark, sf_dir, monkeypatch):
    """Slices of a long text count what the whole does; labels are bounded; rubbish goes."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [" ".join(t or "" for t in table(spark, sf_dir)[i : i + 9]) + "Aé ñ İx" for i in range(0, 45, 9)]
    whole = [np.bincount(language_id.features([t])[0].ravel(), minlength=(1 << language_id.BITS) + 1) for t in texts]
    model = language_id.fit(frame)
    names, scores, margins = model.judge(texts)
    monkeypatch.setattr(language_id, "CHUNK", 1000)
    for t, counts in zip(texts, whole, strict=True):
        assert (language_id.count_columns(t)[:-1] == counts[:-1]).all()
    again = model.judge(texts)
    assert again[0] == names and np.allclose(again[1], scores) and np.allclose(again[2], margins)
    monkeypatch.setattr(language_id, "MOST_LABELS", 1)
    with pytest.raises(Exception, match="labels"):
        language_id.fit(frame)
    rows = [(1, texts[0], "s", None, None), (2, "xqzv kjwq zzxq qqjx vvkq wxzj qkzx jjqv", "s", "en", None), (3, "\u4f60\u597d\u4e16\u754c" * 9, "s", None, None), (4, texts[1], None, "kept", None)]
    left = {r.doc_id: r.lang for r in language_id.drop_unknown(spark.createDataFrame(rows, SCHEMA), model, fill="lang").collect()}
    assert left == {1: names[0], 4: "kept"}


def test_embedding_scales_and_lengths(spark):
    """Components near the ends of double, parts of different lengths in one table, and one that is hot."""
    rng = np.random.default_rng(4)
    rows = [(i, (10.0**e * v).tolist(), "a") for i, (e, v) in enumerate((e, np.array([1.0, 2.0, 3.0])) for e in (-300, -200, 0, 200, 300))]
    rows += [(10, [1.0, 2.0], "a"), (11, [-0.0, 1.0], "b"), (12, [0.0, 1.0], "b"), (13, [5e-324, 0.0], "b")]
    center = rng.standard_normal(8)
    rows += [(100 + i, (center + 0.01 * rng.standard_normal(8)).tolist(), "c") for i in range(400)]
    measured = {}
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string"), measured=measured).collect()}
    assert [got[i].n_links for i in range(5)] == [4] * 5 and {got[i].component_id for i in range(5)} == {0}
    assert got[10].n_links == 0 and got[11].n_links == got[12].n_links == 1 and got[13].n_links == 0
    assert {got[100 + i].n_links for i in range(400)} == {399} and {got[100 + i].component_id for i in range(400)} == {100}
    assert set(measured) == {"8:c"} and measured["8:c"] == 1.0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_mix(rows):
    """Times that each (id, text, source) is taken; rows have ids of their own."""
    size = {r[0]: len(words_of(r[1])) for r in rows}
    by = {}
    for i, _, source in rows:
        by.setdefault(source, []).append(i)
    names = sorted(x for x in by if x is not None) + [None] * (None in by)
    total = {x: sum(size[i] for i in by[x]) for x in names}
    weight, budget, full = {x: mixing.WEIGHTS[k % 3] for k, x in enumerate(names)}, sum(total.values()), set()
    while True:
        free = [x for x in names if x not in full]
        rest = budget - sum(3 * total[x] for x in full)
        share = {x: rest * weight[x] / sum(weight[y] for y in free) for x in free} | {x: 3 * total[x] for x in full}
        over = {x for x in free if share[x] > 3 * total[x]}
        if not over:
            break
        full |= over
    queue = []
    for x in names:
        before = 0
        for h, i in sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i) for i in by[x]):
            if size[i]:
                queue += [((p * total[x] + before + size[i]) / share[x], h, p, i) for p in range(3)]
            before += size[i]
    took, used = dict.fromkeys(size, 0), 0
    for *_, i in sorted(queue):
        used += size[i]
        took[i] += used <= budget
    return took


def test_pipeline(spark, sf_dir, reference_bpe):
    """Every stage against a plain version of it, by multiplicity."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "mixing", "byte_bpe"]
    rows = {r.doc_id: (r.text, r.source, r.lang) for r in frame.collect()}
    known = corpus_pipeline.known_language(spark, frame, sf_dir)
    assert known.columns == frame.columns
    kept = {r.doc_id: r.lang for r in known.collect()}
    assert set(kept) == {i for i, (t, _, _) in rows.items() if t and any(map(str.isalpha, t))}
    assert all(kept[i] == rows[i][2] for i in kept if rows[i][2])
    last = {rows[i][0]: i for i in sorted(kept)}
    ids = sorted(last.values())
    prints = [brute_fingerprint(rows[i][0]) for i in ids]
    least = brute_links(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    firsts = [ids[k] for k in sorted(set(least))]
    times = plain_mix([(i, rows[i][0], rows[i][1]) for i in firsts])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        if got[r.doc_id] == 1:
            assert r.ids == reference_bpe.encode_ordinary(rows[r.doc_id][0])
    assert got == {i: n for i, n in times.items() if n}


def test_pipeline_cases(spark, tmp_path):
    """An empty table, null ids, repeated rows, odd column names."""
    said = "the people of the town have known for years that this was the only road to the other side"
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, _ls_id string, _ls_times int"
    text = lambda k: " ".join(f"{said[(k * 7 + j) % 50:]} {k}" for j in range(4))
    rows = [(i, text(i), "en", f"s{i % 2}", 1, "x", 2) for i in range(8)] + [(3, text(3), "en", "s1", 1, "x", 2), (None, text(30), None, None, 1, None, None), (None, text(30), None, None, 1, None, None), (20, None, "en", "s0", 0, None, None), (21, "", None, "s0", 0, None, None)]
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs_ = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage_name, apply in corpus_pipeline.STAGES[:-1]:
            out = apply(spark, docs_, str(tmp_path))
            assert out.columns == docs_.columns, stage_name
            out.write.parquet(f"{tmp_path}/{name}/{stage_name}")
            docs_ = spark.read.parquet(f"{tmp_path}/{name}/{stage_name}")
            found = [(r.doc_id, r.lang) for r in docs_.collect()]
            if stage_name == "language_id" and some:
                assert len(found) == 11 and {x for x, _ in found} == {None, *range(8)} and all(lang for _, lang in found)
            if stage_name == "exact_dedup" and some:
                assert len(found) == 9
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == docs_.count()
