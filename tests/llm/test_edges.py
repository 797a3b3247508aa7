"""Edge cases of the training-data operators: hot groups, repeated and missing ids, empty tables, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelspark.llm import bpe, chat, exact_dedup, mixing, ngram_join, quality, queries_secrets, secrets, sharding, token_files, url_filter
from panelspark.llm.queries_tokens import encode_and_decode, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string"


def components_of(texts):
    """Smallest index reachable by links, by all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(texts)))

    def root(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.fixture(scope="module")
def hot_texts():
    """A large group of near copies at all distances, documents around one common passage, copies, short texts."""
    r = random.Random(20)
    word = lambda: f"w{r.randrange(5000)}"
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(70)]
    out = []
    for _ in range(160):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 5, 8))):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(120):
        n = r.choice((5, 12, 20, 30, 50, 90))
        out.append(" ".join([word() for _ in range(n)] + passage + [word() for _ in range(r.randrange(4))]))
    chain = [word() for _ in range(60)]
    for _ in range(12):  # each near the one before
        chain = chain[4:] + [word() for _ in range(4)]
        out.append(" ".join(chain))
    out += [" ".join(word() for _ in range(r.randrange(1, 60))) for _ in range(60)]
    out += r.sample(out, 20) + ["", " ", None, "one", "ONE", "a b c d", "A b\tc d", "a b c d e"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("held", [4096, 16])
def test_ngram_join_hot_groups(spark, hot_texts, monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD", held)
    monkeypatch.setattr(ngram_join, "SMALL", min(held, ngram_join.SMALL))
    want, sizes = components_of(hot_texts)
    df = spark.createDataFrame(list(enumerate(hot_texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == {i: (sizes[i], want[i]) for i in range(len(hot_texts))}


def test_ngram_join_missing_ids(spark):
    r = random.Random(21)
    t = [f"w{r.randrange(999)}" for _ in range(60)]
    near = " ".join(t[:-1])
    rows = [(None, " ".join(t)), (7, near), (7, "other words stand here by themselves"), (None, None), (-(1 << 63), "")]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, 56, 7), (7, 55, 7), (7, 2, 7), (None, 0, None), (-(1 << 63), 0, -(1 << 63))])


def test_quality_keep_follows_each_row(spark):
    r = random.Random(22)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(100)), "en", "s") for i in range(60)]
    fine = " ".join(word() for _ in range(100))
    again = " ".join(["abcde", "bcdea", "cdeab", "deabc"] * 25)  # as many words, characters and symbols
    df = spark.createDataFrame([*rows, (900, fine, "en", "s"), (900, again, "en", "s"), (None, fine, "en", "s"), (None, None, None, None)], DOCS).withColumn("text_key", F.lit("mine"))
    got = [(x.doc_id, x.text) for x in quality.keep(df).collect()]
    assert (900, fine) in got and (None, fine) in got and (900, again) not in got and (None, None) not in got
    assert quality.keep(df).columns == df.columns


@pytest.mark.parametrize("bits", [2, 4, 26, 61])
def test_repeat_words_with_few_hash_bits(spark, bits):
    r = random.Random(23)
    rows = [(i, [r.choice("abcd") for _ in range(r.randrange(0, 40))]) for i in range(60)] + [(99, ["a"] * 30), (100, [str(k) for k in range(500)] + ["1", "2", "3"])]
    got = spark.createDataFrame(rows, "i int, w array<string>").select("i", quality.repeat_words(F.col("w"), bits).alias("n")).collect()
    for g in got:
        w = dict(rows)[g.i]
        n = Counter(zip(w, w[1:], w[2:]))
        assert g.n == len({k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}), w


def by_hand(text):
    """Spans of the secret scan, each window's entropy from its own count."""
    found = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    hot = set()
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        for c in secrets.CLASSES:
            i = m.start()
            while i < m.end():
                j = i
                while j < m.end() and text[j] in c.alphabet:
                    j += 1
                run = text[i:j]
                if len(run) >= 20 and m.end() - m.start() >= 20 and not any(a.fullmatch(run) for a in secrets.ALLOW):
                    size = min(c.window, len(run))
                    for k in range(len(run) - size + 1):
                        h = -sum(n / size * math.log2(n / size) for n in Counter(run[k : k + size]).values())
                        if h >= c.bits * math.log2(size) / math.log2(c.window) - 1e-9:
                            hot.update((i + k + x, i + k + x + 1) for x in range(size))
                            hot.add(("cut", i + k))
                i = max(j, i + 1)
    cells = sorted(x[0] for x in hot if x[0] != "cut")
    spans = []
    for x in cells:
        if spans and x <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], x + 1))
        else:
            spans.append((x, x + 1))
    return sorted(found + [(a, 3, b) for a, b in spans])


def test_secret_query_by_hand(spark, tmp_path):
    r = random.Random(24)
    pieces = ["token=", "Api_Key: '", "PASSWORD = \"", "secret:short", " ", "\n", "ſecret=abcdefgh1", "toKen=abcdefgh1", "İ", "AKIA", "deadbeef", "https://a.b/c/d-e_f", "=", "é", "plainwordsonlyherefriends", "ThisIsACamelCaseNameOfAThing"]
    draw = lambda a, n: "".join(r.choice(a) for _ in range(n))
    rand = [lambda: draw("0123456789abcdef", r.randrange(20, 70)), lambda: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r.randrange(4, 40)), lambda: draw("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 30), lambda: draw("abcXYZ019+/_=-", r.randrange(5, 60))]
    texts = ["".join(r.choice(pieces) if r.random() < 0.6 else r.choice(rand)() for _ in range(r.randrange(1, 30))) for _ in range(150)] + [None, "", "token" * 1000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for g in queries_secrets.op8_secret_scan(spark, str(tmp_path)).collect():
        want = by_hand(texts[g.doc_id] or "")
        line = lambda xs: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in xs)
        assert g.spans == line(want)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert g.base_sha256 == hashlib.sha256(line([x for x in want if x[1] < 3]).encode()).hexdigest()


def test_redact():
    assert secrets.redact("a token=abcdefgh z", secrets.base_spans("a token=abcdefgh z")) == "a [assign] z"
    assert secrets.redact("", []) == ""


def test_letters_only_keys_are_judged():
    r = random.Random(25)
    hits = sum(bool(secrets.entropy_spans("key " + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40)))) for _ in range(100))
    assert hits > 90


def test_chat_null_ids_and_long_conversations(spark):
    rows = [(None, 1, "user", "hi"), (None, 1, "user", "hi"), (None, 1, "user", "else"), (1, 1, "user", "hi"), (1, 2, "bot", "yes")]
    long = [(9, k, "user", f"turn {k}") for k in range(3000)] + [(8, k, "user", f"turn {k}") for k in range(2999)] + [(7, k, "user", f"turn {k}") for k in range(2998)] + [(7, 2998, "user", "end")]
    df = spark.createDataFrame(rows + long, "conv_id long, turn long, role string, text string").withColumn("k", F.lit("own"))
    got = {(r.conv_id, r.n_turns, r.n_copies): r.chat for r in chat.format_chats(df).collect()}
    assert set(got) == {(None, 1, 1), (1, 2, 1), (9, 3000, 1), (7, 2999, 1)}
    assert got[None, 1, 1] == "<|user|>\nelse\n" and got[9, 3000, 1] == "".join(f"<|user|>\nturn {k}\n" for k in range(3000))


def test_url_long_and_clashing(spark):
    rows = [(i, f"https://a{i}.example.org/fr/{i}") for i in range(30)] + [(50 + i, f"http://b{i}.test.com/de/{i}") for i in range(30)]
    rows += [(100, "http://x.net/de/?" + "q" * 50_000), (101, "http://x.net/p?a=/de/1"), (102, "http://x.net/p?a=/fr/1"), (103, ""), (104, None), (None, "http://x.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"text": F.lit(1), "host": F.lit(2), "gram": F.lit(3)})
    got = {r.page_id: r for r in url_filter.classify(df).collect()}
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got.values())
    assert got[101].score != got[102].score  # the query counts
    assert got[100].path == "/de/" and got[103].score == got[104].score


def test_write_shards(spark, tmp_path):
    r = random.Random(26)
    rows = [(i % 50, "x" * r.randrange(0, 300)) for i in range(400)] + [(None, None), (None, None), (3, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("mine"), "depth": F.lit(7), "prefix": F.lit("p")})
    found = sharding.write_shards(df, 2000, f"{tmp_path}/s").collect()
    back = spark.read.parquet(f"{tmp_path}/s")
    assert Counter((x.doc_id, x.text, x.shard, x.depth, x.prefix) for x in back.collect()) == Counter((*row, "mine", 7, "p") for row in rows)
    sizes = {x["_shard"]: (x.b or 0, x.n) for x in back.groupBy("_shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {f"s{format(x.prefix, f'0{x.depth}b') if x.depth else ''}": (x.shard_bytes, x.shard_rows) for x in found}
    assert all(x.shard_bytes <= 2000 or x.oversized for x in found)
    assert sharding.write_shards(df.limit(0), 2000, f"{tmp_path}/none").count() == 0


def test_sharding_beyond_the_first_level(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(300)] + [(7, "z" * 3000)] * 2, "doc_id long, text string")
    got = sharding.assign(df, 1500).collect()
    shards = {}
    for g in got:
        shards.setdefault(g.shard, []).append(g)
    assert len(got) == 302 and max(map(len, shards)) == 32  # equal rows can't be parted
    for name, own in shards.items():
        assert sum(g.bytes for g in own) == own[0].shard_bytes and own[0].depth == len(name) and (own[0].shard_bytes <= 1500) != own[0].oversized
        assert sum(g.bytes for g in got if g.shard.startswith(name[:-1])) > 1500


def test_dedup_least_id_and_empty(spark):
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "a b"), (5, "ab"), (5, "a b"), (None, "a  b"), (1, "c"), (1, None), (2, "")], "doc_id long, text string").withColumns({"sha": F.lit(1), "rid": F.lit(2), "kept": F.lit(3)})
    got = {(r.doc_id, r.n_points): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(df).collect()}
    assert got[None, 4] == (None, 4, True) and got[least, 3] == (None, 4, False) and got[1, 0] == (1, 2, True) and got[1, 1] == (1, 1, True)
    assert exact_dedup.dedup(df).columns == df.columns and exact_dedup.dedup(df).count() == 3
    assert exact_dedup.decide(df.limit(0)).count() == 0 and exact_dedup.dedup(df.limit(0)).count() == 0


def test_repeated_rows_are_encoded_once_and_all_told(spark):
    r = random.Random(27)
    words = [f"word{r.randrange(300)}" for _ in range(2000)]
    shared = " ".join(words[:600])
    rows = [(i, shared + f" end {i}") for i in range(5)] * 3 + [(5, "alone"), (5, "alone"), (5, None), (None, None), (None, "alone"), (6, "y " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumns({"ids": F.lit(1), "row": F.lit(2)})
    once = {(x.doc_id, x.n_tokens, x.ids_sha256) for x in encode_and_decode(df).collect()}
    want = Counter(map(tuple, encode_and_decode(spark.createDataFrame(sorted(set(rows), key=str), "doc_id long, text string")).select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert once == set(want)
    assert bpe.round_trip(df, tokenizer_path()).count() == len(rows)
    assert encode_and_decode(df.limit(0)).count() == 0 and secrets.scan(df.limit(0)).count() == 0
    assert token_files.read(token_files.write(df, tokenizer_path(), 2)).count() == len(rows)


def brute_mix(rows, seed=7):
    """Rows (doc_id, text, lang, source, n_chars) as the mix takes them: sorted by key within sources and cut at each budget."""
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    md5 = lambda b: hashlib.md5(b).hexdigest()
    sources = sorted({x[3] for x in rows}, key=lambda v: (v is None, v or ""))
    size = {v: sum(len(words_of(x[1])) for x in rows if x[3] == v) for v in sources}
    weight = {v: (5, 2, 1)[k % 3] for k, v in enumerate(sources)}
    left, open_, target = 1.5 * sum(size.values()), set(sources), {}
    while open_:
        level = left / sum(weight[v] for v in open_)
        full = {v for v in open_ if level * weight[v] > 2 * size[v]}
        if not full:
            target |= {v: level * weight[v] for v in open_}
            break
        target |= {v: 2.0 * size[v] for v in full}
        left -= sum(target[v] for v in full)
        open_ -= full
    out = Counter()
    for v in sources:
        own = sorted((md5(f"{seed}:{'' if x[0] is None else x[0]}:{md5((x[1] or '').encode())}".encode()), x) for x in rows if x[3] == v and words_of(x[1]))
        budget = math.floor(target[v] + 1e-9) if own else 0
        while budget > 0:
            for _, x in own:
                w = words_of(x[1])
                take = min(len(w), budget)
                budget -= take
                if take == len(w):
                    out[x] += 1
                elif take:
                    cut = " ".join(w[:take])
                    out[(x[0], cut, x[2], x[3], len(cut))] += 1
    return out


def test_mix_of_rows_that_repeat(spark):
    """Rows without ids, and a third of all rows alike: the cut falls among them, and takes as many as it should."""
    r = random.Random(31)
    rows = [(None, "same words here again", "en", "a", 21)] * 300 + [(None if k % 3 else k, " ".join(r.choice("xyzuvw") for _ in range(r.randrange(0, 9))), "en", r.choice("ab"), 9) for k in range(300)]
    rows += [(7, "one", "en", None, 3), (8, None, "en", "b", 0), (9, " ", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS + ", n_chars long").repartition(5)
    assert Counter(map(tuple, mixing.apply_mix(df).collect())) == brute_mix(rows)
    for seed in range(8, 14):
        assert Counter(map(tuple, mixing.apply_mix(df, seed=seed).collect())) == brute_mix(rows, seed)
    taken = mixing.mix(df).collect()
    assert len(taken) == len(rows) and all(0 <= g.taken <= 2 * g.size for g in taken)
    for v in ("a", "b", None):
        own = [g for g in taken if g.source == v]
        assert sum(g.taken for g in own) == math.floor(own[0].target + 1e-9)


def test_columns_of_the_caller_stay(spark, hot_texts):
    """No name of a caller's column meets one of an operator's own."""
    names = "__id __n __sha __key __size __own __part __i __taken __hash whole maybe rid sha key id own_key part size rest epochs place row n_before inside low cut of level distance kept n_words base_failed stays cls best c w text_key".split()
    rows = [(k, t, "en", f"s{k % 2}") for k, t in enumerate(hot_texts[:120])]
    plain = spark.createDataFrame(rows, DOCS)
    df = plain.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id")) for n in names})
    for stage in (exact_dedup.dedup, ngram_join.one_of_each, quality.keep, mixing.apply_mix):
        got = stage(df)
        assert got.columns == df.columns
        out = got.collect()
        assert all(g[n] == f"{n}-{g.doc_id}" for g in out for n in names)
        assert Counter(tuple(g)[:4] for g in out) == Counter(map(tuple, stage(plain).collect())) and out


def test_pipeline_by_hand(spark, hot_texts):
    """Each stage against what its rows must be: counts and verdicts, one of equal texts, one of each component, budgets, ids."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = [(i % 400 if i % 7 else None, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(hot_texts)]
    df = spark.createDataFrame(rows, DOCS + ", n_chars long")
    kept = stages["quality_rules"](spark, df, "").collect()
    numbered = spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(rows)], df.schema)
    fate = {g.doc_id: g.kept for g in quality.judge(numbered).collect()}
    assert Counter(map(tuple, kept)) == Counter(x for k, x in enumerate(rows) if fate[k]) and 0 < len(kept) < len(rows)

    one = stages["exact_dedup"](spark, spark.createDataFrame(kept, df.schema), "").collect()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert len(one) == len({plain(x.text) for x in kept}) == len({plain(x.text) for x in one})
    near = stages["ngram_join"](spark, spark.createDataFrame(one, df.schema), "").collect()
    comp, sizes = components_of([x.text for x in one])
    place = {(x.doc_id, x.text): k for k, x in enumerate(one)}
    assert len(near) == len(set(comp)) == len({comp[place[x.doc_id, x.text]] for x in near})
    for x in near:
        group = [one[k].doc_id for k in range(len(one)) if comp[k] == comp[place[x.doc_id, x.text]]]
        assert x.doc_id == min((d for d in group if d is not None), default=None)
    mix = stages["mixing"](spark, spark.createDataFrame(near, df.schema), "").collect()
    assert Counter(tuple(x) for x in mix) == brute_mix([tuple(x) for x in near])
    last = stages["bpe"](spark, spark.createDataFrame(mix, df.schema), "").collect()
    from panelspark.llm.tokens import Encoder

    t = Encoder(tokenizer_path()).whole
    assert Counter((x.doc_id, x.n_tokens) for x in last) == Counter((x.doc_id, len(t.encode(x.text or "", add_special_tokens=False).ids)) for x in mix)
    none = spark.createDataFrame([], df.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
