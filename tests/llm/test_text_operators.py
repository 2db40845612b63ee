"""Each text operator against brute force, on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF, rows_of, rows_of_sql
from pyspark.sql import functions as F

from sparkloom.llm import (
    bpe,
    chat_format,
    exact_dedup,
    packing,
    quality_gam,
    quality_rules,
    registry,
    simhash,
    text_stats,
    toxicity,
    trees,
    url_filter,
    warc,
)
from sparkloom.llm.common import scratch

P = pytest.importorskip("public_tokenizers")

TEXTS = [
    "",
    None,
    "one",
    "two words",
    "The cat sat on the mat. The cat sat on the mat.",
    "a\nb\na\n\n \na",
    "Zeile mit Ä und ß.\tNoch eine\x0bZeile\r\nEnde",
    "x" * 5000,
    "word " * 3000,
    "日本語 テキスト 🙂 <|endoftext|> don't STOP!!",
]


def docs(spark, texts=TEXTS, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumn("kept", F.lit("mine")).withColumn("stats", F.lit(1)) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# --- registered SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == rows_of_sql(duck, registry.ORACLE_SQL[name])


# --- 1 url filters

URLS = [
    "http://X.ORG/es/", "http://example.org", "https://example.org/en/123?x", "a://b.com/fr/x#?", "nourl", None, "",
    "://org/", "http://notorg/", "http://org:80/", "http://a.example.org/en/1", "ftp://x/y://z.org/es/", "http://example.org/ES/",
    "http://a\nb.org/de/", "http://com/de/", "http://x.com/de", "http://spam-farm.example.net/a", "http://x.org/wp-login.php",
    "http://www.example.org/es/", "http://badexample.org/es/", "http://q.net/cart/checkout/",
]


def slow_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        end = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
        path = rest[:end]
    best = None
    for verdict, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


@pytest.mark.parametrize("inline", [2000, 0])
def test_url_filter(spark, inline):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id int, url string").withColumn("rule", F.lit("mine"))
    got = url_filter.judge(df, inline_rules=inline).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, best = slow_judge(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None), r
        if best:
            assert r.verdict == best[1]
    by_id = {r.page_id: r for r in got}
    assert by_id[16].verdict == "block" and by_id[16].rule is None
    assert by_id[20].verdict == "block" and by_id[4].verdict == "allow"
    assert url_filter.judge(df.limit(0), inline_rules=inline).count() == 0


def test_url_paths_begin_after_the_first_scheme(spark):
    urls = ["http://x.com?next=http://y.net/de/p", "http://x.com#http://y.net/de/p", "http://x.com?a=/b", "http://x.com", "http://x.com/de/?u=a://b/c"]
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, best = slow_judge(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None), r


# --- 2 byte BPE


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Codec(bpe.read_ranks(path), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(3)
    pools = ["ab", "abcdefgh ", "aaaa  \n\t'sS", "éèàüñß çñ'll're日本語🙂́ 12", "".join(map(chr, range(32, 127)))]
    texts = ["".join(rng.choice(pools[k % 5]) for _ in range(rng.randint(0, 80))) for k in range(3000)]
    texts += ["a" * 20000, " " * 9999 + "x", "ab" * 5000, ""]
    want = [np.array(lib.encode_ordinary(x), dtype="<u4").tobytes() for x in texts]
    assert own.encode(texts) == want
    assert [own.decode(x).decode() for x in want] == texts
    small = bpe.Codec(own.ranks, P.PATTERN, cache_words=3)
    assert [small.encode([x])[0] for x in texts[:200]] == want[:200]
    got = bpe.encode(docs(spark), path, P.PATTERN).withColumn("back", bpe.decode_column(F.col("ids"), path, P.PATTERN)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r.doc_id] or ""
        assert bytes(r.ids) == np.array(lib.encode_ordinary(text), dtype="<u4").tobytes() and bytes(r.back) == text.encode()
    assert bpe.encode(empty(spark), path, P.PATTERN).count() == 0


def test_replay_waits_for_lower_ranks():
    # after "ab" is merged, "abc" has a lower rank than "ab": it goes first, as encoding word by word has it
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 400, b"cab": 500}
    own = bpe.Codec(ranks, r"\w+")

    def slow(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    assert own.encode(words) == [np.array(slow(w.encode()), dtype="<u4").tobytes() if w.encode() not in ranks else ranks[w.encode()].to_bytes(4, "little") for w in words]


# --- 3 quality classifier


def test_quality_classifier(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choice(["the", "of", "and", "house", "river", "stone"]) for _ in range(60)) + "." for _ in range(120)]
    bad = [" ".join(rng.choice(["x***", "y%%%", "z###"]) for _ in range(60)) for _ in range(60)]
    texts = good + bad + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(181, None)], "doc_id bigint, quality int")
    model = quality_gam.fit(df, labels)
    got = {r.doc_id: r.quality_score for r in quality_gam.score(df, model).collect()}
    held = [i for i in range(180) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= 0.3) == (i < 120) for i in held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 182
    alone = quality_gam.fit(df, labels.limit(0))
    assert {r.quality_score for r in quality_gam.score(df, alone).collect()} == {0.5}
    assert quality_gam.score(df.limit(0), model).count() == 0


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit_additive(x[:2000], y[:2000], n_pairs=2, pair_rounds=80)
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.9


# --- 4 chat formatting


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a<|b"), (1, 1, "user", "<"), (1, 2, "assistant", "|im_end|>\n"), (1, 3, "assistant", None),
        (1, 4, "assistant", "<|im_sep|>é🙂<"), (1, 200, "assistant", "x"), (1, 200, "assistant", "x"), (1, 201, None, "<||"),
        (1, None, "a\nb<|n|>", "\n"), (2, 0, "assistant", ""), (None, 1, "user", "<|im_end|><|im_start|>assistant ok"), (None, 0, "user", ""),
    ]
    rows += [(9, i, "assistant" if i % 3 else "user", f"t{i}<|") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    for chunk in (2, 64):
        made = chat_format.format_conversations(df, turns_per_chunk=chunk)
        got = made.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn(
            "loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))
        )
        by = {r.conv_id: r for r in got.collect()}
        assert set(by) == {1, 2, 9, None}
        for conv, r in by.items():
            want = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
            assert [(t.role, t.text) for t in r.turns] == [w[2:] for w in want]
            assert r.loss == "".join(w[3] for w in want if w[2] == "assistant")
            starts = sum(i == 0 or w[2] != want[i - 1][2] for i, w in enumerate(want))
            assert r.formatted.count("<|im_start|>") == starts  # adjacent turns of a role share a block
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# --- 5 exact dedup


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    texts = ["a", "b", "a", None, "", "a ", "A", "b", "long " * 1000, "long " * 1000, "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("keep_id", F.lit("clash"))
    options = {"digest": lambda t: (F.crc32(t.cast("binary")) % 3).cast("string")} if weak else {}
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(df, **options).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
    if not weak:
        assert sorted(r.doc_id for r in exact_dedup.keep_one(df).collect()) == [2, 4, 5, 6, 7, 9, 10]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_exact_dedup_goes_on_from_its_state(spark):
    inbox, state, out = (scratch(spark, n) for n in ("in", "state", "out"))
    kind = "digest string, id bigint, place string"
    spark.createDataFrame([("x", 1, "p"), ("y", 2, "p")], kind).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    exact_dedup.fold(inbox, schema, state, out, spark)
    spark.createDataFrame([("x", 5, "q"), ("z", 3, "q")], kind).write.mode("append").parquet(inbox)
    got = {r.digest: (r.n, r.keep.id, r.keep.place) for r in exact_dedup.fold(inbox, schema, state, out, spark).collect()}
    assert got == {"x": (2, 5, "q"), "y": (1, 2, "p"), "z": (1, 3, "q")}


# --- 6 WARC


def test_warc_round_trip_and_pushdown(spark):
    x = "x" * 120
    rows = [(5, "http://a\r\nb", x), (3, None, x), (9, "u", x), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (3, "z", x), (None, "n", x), (7, "u", "é\r\n\r\n" * 50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record_type", F.lit("clash"))
    results = []
    for options in ({}, {"compress": "false"}, {"max_file_bytes": "300"}):
        path = scratch(spark, "warc")
        warc.archive_pages(pages, path, **options)
        results.append(sorted(map(str, warc.read_pages(spark, path).collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    got = warc.read_pages(spark, path).collect()
    for r in got:
        assert r.record_type == ("revisit" if r.page_id in (5, 9, None) else "response")
        assert r.refers_to == (3 if r.record_type == "revisit" else None)
        if r.page_id is not None:
            data = next(h or "" for i, _, h in rows if i == r.page_id).encode()
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    heads = warc.read_archives(spark, path, ["record_type", "target_uri", "record_id"])
    only = heads.where("record_type = 'revisit' and target_uri like 'u%'").collect()
    assert [r.record_id for r in only] == ["<urn:page:9>"]
    nothing = scratch(spark, "warc")
    warc.archive_pages(pages.limit(0), nothing)
    assert warc.read_pages(spark, nothing).count() == 0


def test_warc_steps_over_excluded_payloads(tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path)}, [], False)
    record = lambda kind, size: warc._member(writer._record({"record_type": kind, "payload": random.Random(size).randbytes(size)}), 1)

    class Counted:
        def __init__(self, path):
            self.file, self.read_bytes = open(path, "rb"), 0

        def read(self, n):
            data = self.file.read(n)
            self.read_bytes += len(data)
            return data

        def tell(self):
            return self.file.tell()

        def seek(self, *a):
            return self.file.seek(*a)

    path = tmp_path / "x.warc.gz"
    path.write_bytes(record("response", 500_000) + record("revisit", 10) + record("response", 500_000))
    file = Counted(path)
    got = list(warc.records(file, lambda named: dict(named)["WARC-Type"] == "revisit", True))
    assert len(got) == 1 and len(got[0][1]) == 10 and file.read_bytes < 10_000


# --- 7 toxicity


def test_toxicity(spark):
    rng = random.Random(1)
    plain = [" ".join(rng.choice(["stone", "river", "house", "green", "walks"]) for _ in range(40)) for _ in range(200)]
    mean = [" ".join([*(p.split()[:20]), "you", "are", rng.choice(["an idiot", "a moron", "worthless", "scum"]), *(p.split()[20:])]) for p in plain[:60]]
    texts = plain[60:] + mean + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("toxicity", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(140 <= i < 200)) for i in range(200)] + [(200, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((got[i] >= 0.3) == (i >= 140) for i in held)
    assert got[200] < 0.3 and got[201] < 0.3
    assert toxicity.score(df, toxicity.fit(df, labels.limit(0))).where("toxicity between 0 and 1").count() == len(texts)
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.drop_toxic(df, labels).count() < len(texts)


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    score = rng.normal(size=400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-score))).astype(float)
    x, v = trees.isotonic(score, y)
    assert (np.diff(v) >= -1e-12).all() and abs(np.interp(score, x, v).mean() - y.mean()) < 1e-9


# --- 8 quality rules


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", ln)) and ln in lines[:i] for i, ln in enumerate(lines))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(places)


def test_quality_counts_match_brute_force():
    rng = random.Random(5)
    pool = ["a", "b", "c d", "é", "#", "\n", "\n", " ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "日"]
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert text_stats.text_stats(text.encode())[:5] == slow_counts(text), repr(text)


def test_quality_rules(spark):
    good = [f"The house by the river of stone number {i} is old, and it was in the field with all of the others as they said." * 1 + f" It was the day of the year {i} and this is not that one, for they had to be at the house with the man from the hill and his dog which was as big as an ox. So it is." for i in range(30)]
    bad = ["x*** y%%% z### " * 30, "SHOUT!! LOUD!! " * 40, "w " * 60]
    df = spark.createDataFrame(list(enumerate([*good, *bad, "", None, "too short"])), "doc_id bigint, text string").withColumn("kept", F.lit("mine")).withColumn("stats", F.lit(0))
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert all(got[i].kept for i in range(30)) and not any(got[i].kept for i in range(30, 36))
    kept = quality_rules.keep_good(df)
    assert kept.columns == ["doc_id", "text", "kept", "stats"] and kept.count() == 30 and kept.first()["kept"] == "mine"
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_em_finds_the_bad_rule():
    rng = np.random.default_rng(0)
    state = rng.uniform(size=20000) < 0.8
    right = [0.95, 0.9, 0.5]
    votes = np.column_stack([np.where(rng.uniform(size=20000) < r, state, ~state) * 2 - 1 for r in right])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, like = quality_rules.estimate(patterns, counts.astype(float))
    assert abs(good - 0.8) < 0.08
    lift = np.log(like[:, 1, 2] / like[:, 0, 2])
    assert lift[0] > lift[2] and lift[1] > lift[2]
    assert quality_rules.estimate(np.zeros((0, 3), dtype=int), np.zeros(0))[0] == 0.7


# --- 9 packing


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    tok = packing.tokenizer(path).inner
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma's", "Δelta", "e5"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    got = packing.pack(docs(spark, texts).coalesce(2).withColumn("ids", F.lit("clash")), pool_tokens=4000).collect()
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.doc_tokens == len(want[r.doc_id])
        assert bytes(r.ids) == np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
    assert set(pieces) == set(want)
    for i, parts in pieces.items():
        assert sum(p.length for p in parts) == len(want[i]) * (2 if i == 3 else 1)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and {r.sequence_length for r in parts} == {at}
    assert packing.pack(empty(spark)).count() == 0


def test_word_tokenizer_equals_the_library():
    path = P.path("word_bpe_49k.json")
    own = packing.WordTokenizer(path, cache_words=50)
    rng = random.Random(1)
    pool = "aàéZß'  \t\n\x1c\x85\xa0<|>endoftext|>startoftext123½²³ǅİıſ'st're!!??Σς̈日本ﬁ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["a<|endoftext|>b"]
    assert own.encode(texts) == [np.array(own.inner.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


def test_word_tokenizer_equals_the_library_for_each_character():
    own = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    texts = [x for c in map(chr, range(0x250)) for x in (c, f"{c}kra", f"a{c}b {c} 1{c}")]
    assert own.encode(texts) == [np.array(own.inner.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


def test_step_groups_are_even():
    rng = random.Random(0)
    packer = packing.Packer()
    for i in range(3000):
        packer.add(i, 0, rng.randint(1, 1500))
    windows = list(packer.windows())
    steps = packing.deal_steps(windows, packing.STEP_TOKENS)
    total = np.bincount(steps, [sum(n for _, _, n in w) for w in windows])
    assert total.max() - total.min() <= 2048


# --- 10 SimHash


def slow_groups(prints, distance=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("limit", [4096, 3])
def test_simhash_links(spark, limit):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp bigint")
    found = simhash.links(df, bucket_limit=limit).collect()
    assert all(((r.src & (1 << 64) - 1) ^ (r.dst & (1 << 64) - 1)).bit_count() <= 3 for r in found)
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        a, b = find(r.src & (1 << 64) - 1), find(r.dst & (1 << 64) - 1)
        parent[max(a, b)] = min(a, b)
    want = slow_groups(prints)
    mine = [find(x) for x in prints]
    assert len({*zip(mine, want, strict=True)}) == len(set(mine)) == len(set(want))


def slow_fingerprint(text):
    import re

    import xxhash

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_documents(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice(["ab", "Cd", "ef", "gh", "ÄÖ"]) + str(rng.randint(0, 50)) for _ in range(300)) for _ in range(8)]
    texts = TEXTS + base + [b + " x" for b in base] + base[:2]
    df = docs(spark, texts).withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts) + 1
    prints = [slow_fingerprint(t) for t in texts]
    groups = slow_groups(prints)
    for r in got:
        assert r.fp & (1 << 64) - 1 == prints[r.doc_id]
        assert r.component_id == groups[r.doc_id]
    kept = sorted({r.doc_id for r in simhash.keep_one(df).collect()})
    assert kept == sorted(set(groups))
    assert simhash.near_duplicates(empty(spark)).count() == 0
