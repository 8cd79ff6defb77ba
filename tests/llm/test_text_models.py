"""Sentencepiece offsets, personal data, toxicity, quality and URLs."""

import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from orgloom.llm import pii, quality, sentencepieces, toxicity, url_filter
from orgloom.llm.queries import URL_RULES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score string, y int, hash_of_key int, chars int"
TEXTS = ["", None, "Hello  world", "é日本🙂 a\n b", "   ", " x ", "word " * 5000, "▁", "a\tb"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i else None, t, "s", 1, 1, None) for i, t in enumerate(texts)], DOCS)


def test_pieces_and_offsets(spark):
    encoder = sentencepieces.OffsetEncoder(MODEL)
    rows = sentencepieces.encode(docs(spark), MODEL).collect()
    digests = {r["doc_id"]: r for r in sentencepieces.encode_digests(docs(spark), MODEL).collect()}
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"] or 0] or ""
        ids = encoder.model.encode(text, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == encoder.model.decode(ids)
        raw, at = text.encode(), 0
        for b, e in zip(r["begins"], r["ends"]):
            assert b in (at, e) and e >= b
            at = e
        assert at == len(raw)
        d = digests[r["doc_id"]]
        assert d["n_tokens"] == len(ids) and d["span_bytes"] == len(raw)
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sentencepieces.encode(docs(spark).limit(0), MODEL).count() == 0


def test_character_map_is_the_library_s():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(2)
    for rule in ("nfkc", "nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(lib.serialized_model_proto())
        own = sentencepieces.CharsMap(proto.normalizer_spec.precompiled_charsmap)
        for _ in range(300):
            text = "".join(rng.choices(["ﬁ", "①", "Ａ", "é", "é", "x", "ß", "㍿", "가", "ｶﾞ", "🙂"], k=rng.randint(1, 9)))
            out, source = own.apply(text.encode())
            assert out.tobytes().decode() == lib.normalize(text).removeprefix("▁")
            assert (np.diff(source) >= 0).all() and len(source) == len(out)


def plain_spans(text):
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return found + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_the_patterns():
    rng = random.Random(5)
    for letters in ("ab@.-1 +", "12.3 -+()", "a1@@.. _%é٣", "0000 -."):
        for _ in range(3000):
            text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
            assert pii.base_spans(text) == plain_spans(text), text
    for _ in range(50):
        text = "".join(rng.choices("ab.-1", k=rng.randint(100, 400))) + "@a.bc " + "".join(rng.choices("ab.-1@", k=60))
        assert pii.base_spans(text) == plain_spans(text)
    pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + " " + "a." * 100_000 + "@")


def test_field_adds_to_base_spans(spark):
    card = "4111111111111111"
    texts = [f"mail a.b@c{i}.de, host 10.0.0.{i % 200}, card {card} or +1 (434) 555-{1000 + i} ok" for i in range(200)] + ["", None, f"{card}x {card} +1 (434) 555-2368 452413226"]
    rows = docs(spark, texts)
    field = pii.fit(rows)
    got = {r["doc_id"]: r for r in pii.find(rows, field).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        r = got[i if i else None]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(filter(None, pii.listed(base).split(","))) <= set(r["spans"].split(","))
    assert got[202]["n_added"] > 0
    hidden = {r["doc_id"]: r["text"] for r in pii.mask(rows, field).collect()}
    assert hidden[201] is None and hidden[200] == "" and "@" not in hidden[5] and card not in hidden[5]


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(0)
    n = pii.Nodes(np.zeros(4, int), np.arange(4), np.arange(4), np.zeros(4, int), np.full((4, 5), pii.BUCKETS), np.array([[0, 1], [1, 2]]), np.array([[2, 3]]))
    n.features[:, 0] = np.arange(4)
    field = pii.SkipChainField(rng.normal(size=(pii.BUCKETS + 1, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    score = field.emission[n.features].sum(axis=1)
    joint = np.zeros((5,) * 4)
    for lab in np.ndindex(joint.shape):
        joint[lab] = sum(score[i, lab[i]] for i in range(4)) + field.chain[lab[0], lab[1]] + field.chain[lab[1], lab[2]] + field.skip[lab[2], lab[3]]
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    want = [joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)]
    assert np.allclose(field.marginals(n, rounds=60), want, atol=1e-3)


def labelled(spark, good, bad, n=120):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(good, k=40)) + (" " + " ".join(bad) if i % 3 == 0 else ""), "s", 1, 1, None) for i in range(1, n)]
    return spark.createDataFrame([*rows, (None, None, "s", 1, 1, None), (n, "", "s", 1, 1, None)], DOCS), spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(1, n)], "doc_id long, toxic int, quality int")


def test_toxicity_learns_ngrams(spark):
    df, labels = labelled(spark, ["garden", "river", "table", "walks", "green"], ["rotten", "rottish"])
    model = toxicity.fit(df, labels.filter("doc_id < 80"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(80, 120)) and 0 <= got[None] <= 1 and got[120] == got[None]
    assert toxicity.score(df.limit(0), model).count() == 0
    one_class = toxicity.fit(df, labels.filter("toxic = 0"))
    assert toxicity.score(df, one_class).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.word_value(model, "rotten") > toxicity.word_value(model, "river")


def plain_counts(text, bits):
    """Hashed n-grams in the distinct words of a text, one by one."""
    row = np.zeros(1 << bits)
    for word in set((text or "").lower().split()):
        line = "\0" + word + "\0"
        for n in toxicity.SIZES:
            for i in range(len(line) - n + 1):
                h = 0
                for c in line[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + n) % 2**64
                h ^= h >> 29
                row[h * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - bits] += 1
    return row


def test_toxicity_is_the_plain_model():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=12)) + " rotten" * (i % 3 == 0) for i in range(60)] + ["", None, "a" * 3000]
    y, bits, ridge = np.array([float(i % 3 == 0) for i in range(63)]), 12, 1e-3
    model = toxicity.train(texts, y, float(np.log(y.sum() / (len(y) - y.sum()))), bits, ridge)
    x = np.array([plain_counts(t, bits) for t in texts])
    shares = [((x[y == k] > 0).sum(axis=0) + 1) / ((y == k).sum() + 2) for k in (0, 1)]
    scale = np.where(x.any(axis=0), np.log(shares[1]) - np.log(shares[0]), 0)
    weights = model.weights.astype(float)
    assert not weights[scale == 0].any()
    z = x @ weights + model.bias
    for text, want in zip([*texts, "rotten ab", "ROTTEN Ab ab", "é " * 2000], [*z, *(plain_counts(t, bits) @ weights + model.bias for t in ("rotten ab", "ROTTEN Ab ab", "é " * 2000))], strict=True):
        assert abs(model.bias + sum(toxicity.word_value(model, w) for w in toxicity.distinct_words(text)) - want) < 1e-3
    own = np.divide(weights, scale, out=np.zeros_like(scale), where=scale != 0)
    slope = lambda p, w: np.append(scale * (x.T @ (p - y)), (p - y).sum()) / len(y) + ridge * np.append(w, 0)
    assert np.abs(slope(1 / (1 + np.exp(-z)), own)).max() < 0.01 * np.abs(slope(np.full(len(y), y.mean()), 0 * own)).max()


def test_odd_rows_are_scored(spark):
    df, labels = labelled(spark, ["garden", "river", "table", "walks", "green"], ["rotten !!!!! 99999", "rottish"])
    long = "river " * 60_000 + "rotten"
    extra = spark.createDataFrame([(7, "garden", "s", 1, 1, None), (7, "rotten", "s", 1, 1, None), (7, "rotten", "s", 1, 1, None), (None, long, "s", 1, 1, None), (500, long, "s", 1, 1, None)], DOCS)
    whole = df.unionByName(extra)
    for module, col in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(whole, labels.withColumn("text", F.lit("clash")).unionByName(labels.withColumn("text", F.lit("again"))), col)
        got = module.score(whole, model).collect()
        assert len(got) == 126 and sum(r["doc_id"] == 7 for r in got) == 4 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] is None or r["doc_id"] in (120, 500)}) == 2  # empty texts, and long ones
        assert module.score(df.select("doc_id", F.lit(None).cast("string").alias("text")).limit(3), model).count() == 3
    held = {r["doc_id"]: r["h"] for r in whole.select("doc_id", toxicity.held_out(F.col("doc_id"), 4, 2).alias("h")).collect()}
    assert held == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in held}


def test_quality_column_is_the_plain_rules(spark):
    df, labels = labelled(spark, ["garden", "river", "table", "Walks", "green."], ["!!!!! 99999 %%%%%"] * 2)
    model = quality.fit(df, labels)
    assert model.rules
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in quality.score(df, model).collect():
        stats = quality.statistics(texts[r["doc_id"]])
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all(low < stats[s] <= high for s, low, high in rule))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and [r[s] for s in quality.STATS] == stats


def test_quality_rules(spark):
    df, labels = labelled(spark, ["garden", "river", "table", "walks", "green"], ["!!!!! 99999 %%%%%"] * 2)
    model = quality.fit(df, labels.filter("doc_id < 80"))
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert len(got) == 121 and all((got[i] >= 0.5) == (i % 3 != 0) for i in range(80, 120)) and 0 <= got[None] <= 1
    assert len(model.rules) < 60 and quality.score(df.limit(0), model).count() == 0
    assert quality.fit(df, labels.limit(0)).rules == []


def test_urls(spark):
    urls = ["http://A.net/x", "http://a.net", "https://b.example.net/en/1", "https://example.com/de/1?x=1", "https://example.com/fr/1", "https://x.org/fr/", None, "no scheme", "http://evil-net/", "http://u@h.ORG:80#f"]
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)] + [(9, urls[9], "c", "d")], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, URL_RULES).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][:3] == ("a.net", "", None)
    assert got[2][2:] == ("example.net/en/", "allow") and got[3][2:] == ("example.com/de/", "block") and got[4][2] is None
    assert got[5][2:] == ("org/fr/", "allow") and got[6][:3] == got[7][:3] == ("", "", None) and got[8][2] is None and got[9][:2] == ("u@h.org:80", "")
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert url_filter.judge(pages, URL_RULES).count() == 11 and url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_url_trees_learn(spark):
    rows = [(i, f"http://h{i % 7}.example.org/{'a' * (i % 9)}" + ("?a=1&b=2&c=3" if i % 2 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path).withColumn("block", (F.col("page_id") % 2).cast("int"))
    model = url_filter.fit(df.filter("page_id < 200"), "page_id", trees=2, depth=2)
    rest = model.with_features(df.filter("page_id >= 200"))
    assert rest.filter((model.margin() > 0) != (F.col("block") == 1)).count() == 0


def test_spans_through_a_character_map(spark, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    made = []
    for source in (sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")):
        made.append(sentencepiece_model_pb2.ModelProto())
        made[-1].ParseFromString(source.serialized_model_proto())
    made[0].normalizer_spec.precompiled_charsmap = made[1].normalizer_spec.precompiled_charsmap
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(made[0].SerializeToString())
    texts = ["ﬁne ①② Ａbc", "é ㍿ x", "", None, "ｶﾞ ｶﾞ 🙂", "plain words", "½ ㎏ ™" * 50]
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepieces.encode(docs(spark, texts + texts), path).collect()
    assert len(rows) == 14
    for r in rows:
        text = (texts + texts)[r["doc_id"] or 0] or ""
        assert r["ids"] == lib.encode(text, add_eos=True) and r["decoded"] == lib.decode(r["ids"])
        raw = text.encode()
        assert all(0 <= b <= e <= len(raw) for b, e in zip(r["begins"], r["ends"])) and list(r["begins"]) == sorted(r["begins"])
        pieces = {lib.id_to_piece(i).lstrip("▁"): raw[b:e].decode() for i, b, e in zip(r["ids"], r["begins"], r["ends"]) if b < e}
        assert all(k in unicodedata.normalize("NFKC", v) for k, v in pieces.items() if k.isascii() and k.isalnum() and v.strip()), pieces  # the last piece of a character has its bytes
    fi = sentencepieces.OffsetEncoder(path).encode("ﬁne")
    assert (fi.begins.min(), fi.ends.max()) == (0, len("ﬁne".encode()))
