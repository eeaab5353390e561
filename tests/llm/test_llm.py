"""Operators against the libraries, brute force and round trips, on small tables with nulls, repeats and odd texts."""

import gc
import hashlib
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "a", "A b", "a  B", "\t\n", "x" * 20_000, "é́ ß İ ſ\u00a0<|endoftext|> 1٣", "w " * 30_000, "Same text here, twice.", "Same text here, twice.", "\\[INST]</s>\\\\<s>", "12 km to Rome. In 1999 Anna paid $5."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "a"), (3, "a")]
    real = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100", "text", "lang").collect()]
    return spark.createDataFrame([(*r, "en") for r in rows] + real, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as n_tokens", "2 as cls", "0 as id")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_op1_counts_as_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    from lsmframe.llm.token_counts import token_counts

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, path).collect())
    texts = [r.text or "" for r in docs.collect()]
    assert got == sorted((len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for x in texts)
    assert token_counts(empty, path).count() == 0


def ids_of(path, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_op6_files_round_trip(spark, docs, empty, tmp_path):
    from lsmframe.llm.token_files import Shard, get, read_shards, write_shards

    path, ids = P.path("word_bpe_49k.json"), ids_of(P.path("word_bpe_49k.json"), 2)
    made = write_shards(docs, f"file://{tmp_path}/ids", path, 2, shard_size=20_000)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in read_shards(made).collect())
    rows = sorted([((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect()])
    want, at = [], 0
    for i, x in rows:
        want.append((i, at, len(ids(x)), crc(ids(x))))
        at += len(ids(x))
    assert got == want and made.count() > 1
    with pytest.raises(ValueError, match="dictionary"):
        Shard(get(made.first().path), b"other")
    assert read_shards(write_shards(empty, f"file://{tmp_path}/none", path, 2)).count() == 0


def test_op10_packs_every_id_once(spark, docs, empty):
    from lsmframe.llm.packing import pack

    path, ids = P.path("word_bpe_49k.json"), ids_of(P.path("word_bpe_49k.json"), 1)
    got = pack(docs, path, segments=16).toPandas()
    size = got.groupby("sequence_id").length.agg(["sum", "size"])
    assert all(n <= 2048 and n & (n - 1) == 0 for n in size["sum"]) and size["size"].max() <= 16
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]]
    texts = {r.doc_id: ids(r.text) for r in docs.collect() if r.doc_id not in (None, 3)}
    for i, g in got[got.doc_id.isin(texts)].groupby("doc_id"):
        g = g.sort_values("start")
        assert list(g.start) == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(texts[i])
        assert all(crc(texts[i][r.start : r.start + r.length]) == r.ids_crc32 for r in g.itertuples())
    assert got.length.sum() == sum(len(ids(r.text)) for r in docs.collect()) and pack(empty, path).count() == 0


@pytest.mark.parametrize(("loss", "masked"), [(300, False), (300, True), (1, True), (2048, True)])
def test_op10_holds_the_loss_limit(spark, loss, masked):
    from lsmframe.llm.packing import pack

    path, ids, rng = P.path("word_bpe_49k.json"), ids_of(P.path("word_bpe_49k.json"), 1), random.Random(loss)
    texts = {k: " ".join(rng.choice(["one", "two", "three", "paper"]) for _ in range(rng.choice([0, 3, 90, 700, 2500]) if loss > 1 else rng.randrange(40))) for k in range(40)}
    sizes = {k: len(ids(x)) for k, x in texts.items()}
    masks = {k: [j >= n // 2 for j in range(n - 1)] if masked and k % 5 else None for k, n in sizes.items()}
    docs = spark.createDataFrame([(k, x, masks[k]) for k, x in texts.items()], "doc_id long, text string, mask array<boolean>")
    got = pack(docs.coalesce(1), path, segments=16, loss=loss, window=9000, mask_col="mask" if masked else None).toPandas()
    size = got.groupby("sequence_id").agg(n=("length", "sum"), segments=("length", "size"), loss=("loss_tokens", "sum"))
    assert all(n <= 2048 and n & (n - 1) == 0 for n in size.n) and size.segments.max() <= 16 and size.loss.max() <= loss
    assert set(got.doc_id) == set(texts)
    for i, g in got.groupby("doc_id"):
        g, want = g.sort_values("start"), ids(texts[i])
        assert list(g.start) == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(want)
        bears = [False, *(masks[i] or [True] * sizes[i])[1:], True][: sizes[i]]
        assert all(crc(want[r.start : r.start + r.length]) == r.ids_crc32 and sum(bears[r.start : r.start + r.length]) == r.loss_tokens for r in g.itertuples())
    if loss == 300:  # the limit acts: prompts without loss make longer sequences
        assert size.loss.max() > 250 and (size.n.max() > 512) == masked


def brute(rows, size, num, den):
    return sorted(((i is not None, i or 0), n, least or 0) for i, n, least in brute_rows(rows, size, num, den))


def brute_rows(rows, size, num, den):
    """(id, shingles, least id of the component) of each row, in order."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return [(r[0], len(sets[k]), min(ids[find(k)], default=None)) for k, r in enumerate(rows)]


def links_of(texts, size, num, den):
    sets = [frozenset(tuple(w[k : k + min(size, len(w))]) for k in range(len(w) - min(size, len(w)) + 1)) if (w := (t or "").encode().lower().split()) else frozenset() for t in texts]
    return {k: sum(bool(a) and j != k and den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets)) for k, a in enumerate(sets)}


def test_op4_deals_hot_shingles_and_classes_to_many_tasks(spark, monkeypatch):
    """With blocks, chosen classes and hot classes of a few rows each: the same components and links."""
    from lsmframe.llm import jaccard_join as j

    for name, value in {"BLOCK": 5, "PIVOTS": 3, "HOT": 4, "FEW": 2, "NAMED": 3, "COPIES": 2, "SMALL": 4, "FIRST": (2, 7)}.items():
        monkeypatch.setattr(j, name, value)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(70):
        w = list(base) if k % 3 else [f"v{x}" for x in range(60)]
        for at in rng.sample(range(60), rng.randrange(3)):
            w[at] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, "w0 w1 w2 " + " ".join(f"y{k}_{x}" for x in range(5))) for k in range(30)]
    rows += [(200 + k, rows[k // 5][1]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((True, r.doc_id), r.n_shingles, r.component_id) for r in j.join_components(docs, 3, 90, 100).collect()) == brute(rows, 3, 90, 100)
    assert {r.doc_id: r.n_links for r in j.join_links(docs, 3, 90, 100).collect()} == {rows[k][0]: n for k, n in links_of([t for _, t in rows], 3, 90, 100).items()}


def test_op4_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """A chain, a star, a pair named twice: as many jobs for any length of a chain, and the labels of the turns over tables."""
    from lsmframe.llm import jaccard_join as j

    name = [hashlib.md5(str(k).encode()).digest() for k in range(260)]  # noqa: S324
    groups = [range(200), range(200, 250), range(250, 252), range(252, 254)]
    pairs = [*zip(range(199), range(1, 200), strict=True), *((200, k) for k in range(201, 250)), (250, 251), (250, 251), (252, 253)]
    want = {bytes(name[k]): bytes(min(name[i] for i in g)) for g in groups for k in g}
    links = spark.createDataFrame([tuple(sorted((bytearray(name[a]), bytearray(name[b])))) for a, b in pairs], "a binary, b binary")
    found = lambda: {bytes(r.cls): bytes(r.comp) for r in j.components(links).collect()}
    spark.sparkContext.setJobGroup("few links", "")
    assert found() == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not j.components(links.limit(0)).count()
    monkeypatch.setattr(j, "FEW", 10)
    assert found() == want


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_op4_components_as_brute_force(spark, docs, empty, size, num):
    from lsmframe.llm.jaccard_join import join_components, join_links

    rng = random.Random(size)
    base = [f"w{k}" for k in range(120)]
    near = []
    for k in range(60):  # a group of near copies larger than SMALL, some linked only through others
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(5)):
            w[at] = f"x{rng.randrange(1000)}"
        near.append((1000 + k, " ".join(w)))
    common = [(2000 + k, " ".join(base[:12] + [f"y{k}_{j}" for j in range(rng.randrange(3, 40))])) for k in range(40)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + near + common
    if size == 3:
        links = join_links(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"), size, num, 100)
        assert {r.doc_id: r.n_links for r in links.collect()} == links_of([t for _, t in rows], size, num, 100)
    got = join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size, num, 100)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in got.collect()) == brute(rows, size, num, 100)
    if size == 3:
        assert join_components(empty).count() == 0


def test_op4_hashes_long_texts_in_parts_alike(monkeypatch):
    from lsmframe.llm import jaccard_join as j

    texts = ["a b  c\t" * 50, "x" * 300, " " * 300, "y" * 90 + " z" * 60 + " ", "é" * 40 + " " + "w" * 200 + "\n q", *ODD]
    want = [j.Words().hashes(t).tolist() for t in texts]
    monkeypatch.setattr(j, "PART", 64)
    words = j.Words(8)
    assert [words.hashes(t).tolist() for t in texts] == want


def test_op4_groups_over_batches_lose_no_pair():
    """However the rows fall into batches, small groups give all their pairs and large ones all their rows."""
    import numpy as np

    from lsmframe.llm.jaccard_join import SMALL, as_rows, small_groups

    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, SMALL, SMALL + 1, 80, 2, 1, 200, 5]
    gram = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
    cls = np.stack([np.arange(len(gram)) // 2, np.zeros(len(gram), np.int64)], axis=1)  # each class twice in a row
    c = {"gram": gram, "cls": cls, "n": np.full(len(gram), 50, np.int32), "pos": np.ones(len(gram), np.int32), "sig": np.zeros((len(gram), 2), np.int64)}
    want = {(int(g), a, b) for g in range(len(sizes)) for s in [sorted(set(cls[gram == g, 0].tolist()))] for k, a in enumerate(s) for b in s[k + 1 :]}
    for step in (1, 3, 7, 64, 1000):
        batches = [as_rows({k: v[i : i + step] for k, v in c.items()}).select(["gram", "a", "n", "pos", "sig", "sig2"]) for i in range(0, len(gram), step)]
        pairs, rows = [], []
        for b in small_groups(iter(batches), 90, 100):
            if b.column(0)[0].as_py() == 0:
                pairs += [(x[0], y[0]) for x, y in zip(*(np.frombuffer(b.column(k).cast("binary").cast(__import__("pyarrow").binary(16)).buffers()[1], np.int64).reshape(-1, 2) for k in (1, 2)), strict=True)]
            else:
                rows.append(b)
        small = {(a, b) for g, a, b in want if len(set(cls[gram == g, 0])) <= SMALL}
        assert {(min(p), max(p)) for p in pairs} >= small
        assert rows and sum(len(b) for b in rows) >= sum(len(set(cls[gram == g, 0])) for g in range(len(sizes)) if len(set(cls[gram == g, 0])) > SMALL)


def test_op2_finds_templates(spark, docs, empty):
    from lsmframe.llm.decontamination import drop_contaminated, find_contaminated

    bench = spark.createDataFrame([(1, "A train leaves at 10 and travels 300 km with Anna while Anna reads 10 pages of the old book."), (2, None), (3, "too short")], "item_id long, text string")
    said = [(9001, "Intro. A train leaves at 20 and travels 450 km with Bob while Bob reads 20 pages of the old book. More."), (9002, "A train leaves at 20 and travels 450 km with Bob while Eve reads 20 pages of the old book."), (9003, "A TRAIN LEAVES late")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(said, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id, r.exact) for r in find_contaminated(rows, bench).collect()}
    assert got == {(9001, 1, False)}
    assert drop_contaminated(rows, bench).count() == rows.count() - 1
    assert find_contaminated(empty, bench).count() == 0 and find_contaminated(rows, bench.where("false")).count() == 0


def contained_in(item, text):
    from lsmframe.llm.decontamination import Canon, Index

    return bool(Index([(1, item)]).find(Canon().tokens(["Other words, then nothing.", f"Some words go first. {text} And more words follow."])))


@pytest.mark.parametrize("size", [6, 8, 15, 20, 28, 41])
def test_op2_finds_copies_with_one_edit(size):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(size)]
    item = " ".join(words)
    for k in range(size):
        for other in (words[:k] + ["zz"] + words[k:], words[:k] + words[k + 1 :], words[:k] + ["zz"] + words[k + 1 :]):
            assert contained_in(item, " ".join(other)), (k, len(other))
    assert not contained_in(item, " ".join(words[: size // 3] + [f"z{x}" for x in words[size // 3 :]]))


def test_op2_joins_runs_of_slots():
    item = "The long train from Rome goes 5 km to the old station while Anna sleeps"
    assert contained_in(item, "The long train from New York goes 7km to the old station while Eve sleeps")
    assert contained_in(item, "The long train from New York City goes 12 to the old station while Mary Ann Smith sleeps")
    twice = "a train leaves Rome and comes back to Rome after 5 km more"
    assert contained_in(twice, "a train leaves New York and comes back to New York after 7 km more")
    assert not contained_in(twice, "a train leaves New York and comes back to Paris after 7 km more")


def test_op2_takes_names_at_the_start_of_a_sentence():
    item = "Anna has 12 apples. Bob gives Anna 5 more. How many apples are there now?"
    assert contained_in(item, "Tom has 9 apples. Eve gives Tom 4 more. How many apples are there now?")
    assert not contained_in(item, "Tom has 9 apples. Eve gives Jim 4 more. How many apples are there now?")
    four = "Anna walks home. Bob walks home. Eve walks slowly. Jim runs home again."
    assert contained_in(four, "Tom walks home. Sue walks home. Max walks slowly. Kim runs home again.")
    assert contained_in(four, "then Tom walks home. Sue walks home. Max walks slowly. Kim runs home again.")


def test_op2_finds_items_with_few_literals_and_short_ones():
    item = "Compute 12 + 7 * 3 - 4 / 2 + 9 - 8"
    assert contained_in(item, item) and not contained_in(item, "Compute 13 + 6 * 3 - 4 / 2 + 9 - 8")
    names = "Anna, Bob, Eve, Jim, Max, Tom, 5, 6, 7"
    assert contained_in(names, f"It was {names}.") and not contained_in(names, "It was Anna, Bob, Eve, Jim, Max, Sue, 5, 6, 9.")
    for short in ("Who wrote Don Quixote?", "Don Quixote", "2 + 2 ="):
        assert contained_in(short, short) and contained_in(short, f"then they asked {short} again")
    assert not contained_in("Who wrote Don Quixote?", "Who wrote War and Peace?")
    assert contained_in("Quixote wrote", "when Don Quixote wrote it") and not contained_in(None, "") and not contained_in("?", "?")


def test_op2_finds_planted_passages(spark):
    import re

    from lsmframe.llm.decontamination import op2_decontamination

    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for i, t in items if t in norm(r.text)}
    assert {(r.doc_id, r.item_id) for r in op2_decontamination(spark, DATA).collect()} == want


def test_op3_reads_back_and_keeps_order(spark, docs, empty):
    from lsmframe.llm.media import interleave, media_features, padded, parse, png, png_samples, resolve, store_media

    for n in (0, 1, 575, 576, 577, 5000):
        assert png_samples(png(padded(bytes(range(256)) * 20)[: max(576, n // 576 * 576)])) == padded(bytes(range(256)) * 20)[: max(576, n // 576 * 576)]
    items = parse('<p>a <b>b</b></p><script>x</script><figure><img src="r1" alt="q"><figcaption>cap &amp; c</figcaption></figure>tail<audio src="r2"></audio>')
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [(0, "text", "a b", None), (1, "image", "r1", "cap & c"), (2, "text", "tail", None), (3, "audio", "r2", None)]
    pages, media = store_media(docs)
    got = resolve(pages, media_features(media), "doc_id")
    want = sorted(hashlib.sha256(padded((r.text or "").encode())).hexdigest() for r in docs.collect())
    assert sorted(r.payload_sha256 for r in got.collect()) == want
    assert store_media(empty)[0].count() == 0
    assert interleave(spark.createDataFrame([(1, None)], "page_id long, html string")).first().items == []


def test_op3_keeps_content_of_unclosed_tags():
    from lsmframe.llm.media import parse

    short = lambda html: [i["text"] or (i["ref"], i["caption"]) for i in parse(html)]
    assert short("<head><title>t</title><body><p>text") == ["text"] == short("<head><meta charset=x><title>t</title>text") == short("<head><title>t</title></head>text")
    assert short("<head><script>a</script><p>one<p>two") == ["one", "two"]
    assert short("<figure><img src=r><figcaption>cap</figure><p>after") == [("r", "cap"), "after"]
    assert short("<figure><img src=r><figcaption>cap") == [("r", "cap")]
    assert short("<p>a</p><figure><pre>code</pre><figcaption>cap</figcaption>b</figure>c") == ["a", "code", "cap", "b", "c"]
    assert short("<figure><figcaption>cap</figcaption><img src=r alt=q></figure>") == [("r", "cap")]


def test_op5_reads_back(spark):
    from lsmframe.llm.chat import escape, format_turn, format_turns, op5_chat_format, read_back, unescape

    rng = random.Random(1)
    for _ in range(3000):
        x = "".join(rng.choice(["\\", "<", "s", ">", "</s>", "[INST]", "<|turn|>", "<|", "é", "[", "/"]) for _ in range(rng.randrange(9)))
        assert unescape(escape(x)) == x and "<|turn|>" not in escape(x) and "</s>" not in escape(x) and "[INST]" not in escape(x)
    text, spans, found, tokens = format_turn("user", [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "r", "units": 2.0}, {"type": "audio", "ref": "s", "units": 0.5}, {"type": None, "text": "end"}])
    assert text.count("<|image|>") == 1 and [a["ref"] for a in found] == ["r", "s"] and tokens == 1152 + 13 and spans == []
    assert [text[a["start"] :].startswith(m) for a, m in zip(found, ("<|image|>", "<|audio|>"), strict=True)] == [True, True] and [a["tokens_before"] for a in found] == [0, 1152]
    got = {r.conv_id: r for r in op5_chat_format(spark, DATA).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    turns = pd.read_parquet(f"{DATA}/conversations.parquet")
    for c, g in turns.sort_values("turn").groupby("conv_id"):
        said = "".join(t or "" for r, t in zip(g.role, g.text, strict=True) if r == "assistant")
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].loss_chars == len(said) and got[c].n_turns == len(g)
    odd = spark.createDataFrame([(None, 0, "user", "x"), (1, None, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in read_back(format_turns(odd)).collect()} == {None: 1, 1: 3}
    alone = spark.createDataFrame([(None, k % 2, "user", "x") for k in range(30)], "conv_id long, turn long, role string, text string")
    assert [r.n_turns for r in read_back(format_turns(alone)).collect()] == [1] * 30
    assert read_back(format_turns(odd.where("false"))).count() == 0


def test_op7_and_op9_learn(spark, docs, empty):
    from lsmframe.llm import language_id, quality
    from lsmframe.llm.common import crc_mod

    real = spark.read.parquet(f"{DATA}/documents.parquet".replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet".replace("0.001", "0.01"))
    model = quality.fit(real, labels.where(crc_mod("doc_id", 5) != 0))
    got = quality.score(real.select("doc_id", "text"), model).join(labels, "doc_id").where(crc_mod("doc_id", 5) == 0).toPandas()
    assert ((got.score >= quality.THRESHOLD) == (got.quality == 1)).mean() > 0.95
    stats = [quality.statistics(t or "") for t in ODD]
    import numpy as np

    want = model.score(np.array(stats))
    by_spark = quality.score(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), model).orderBy("doc_id").toPandas().score
    assert np.allclose(want, by_spark)
    assert quality.score(empty.select("doc_id", "text"), quality.fit(empty, labels.where("false"))).count() == 0
    lang = language_id.fit(real.where(crc_mod("doc_id", 4) != 2))
    got = language_id.predict(real.where(crc_mod("doc_id", 4) == 2).select("text", "lang"), lang).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = language_id.predict(docs.select("doc_id", "text"), lang).toPandas()
    assert set(odd[odd.text.isin(["", " ", "\t\n"]) | odd.text.isna()].lang_pred) == {"und"}
    none = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs.select("text"), none).collect()} == {"und"}


def test_op8_every_shard_fits(spark, docs, empty):
    from lsmframe.llm.sharding import shard

    got = shard(docs, "doc_id", "text", 3000).toPandas()
    assert len(got) == docs.count()
    by = got.groupby("shard").n_bytes.agg(["sum", "size"])
    assert (by["sum"] <= 3000)[by["size"] > 1].all() and (got.groupby("shard").shard_bytes.first() == by["sum"]).all()
    assert not any(a != b and b.startswith(a) for a in set(got.shard) for b in set(got.shard) if "." not in b)
    same = spark.createDataFrame([(7, "x" * 100)] * 50 + [(7, "y" * 900)], "doc_id long, text string")
    got = shard(same, "doc_id", "text", 400).toPandas()
    by = got.groupby("shard").n_bytes.agg(["sum", "size"])
    assert len(got) == 51 and (by["sum"] <= 400)[by["size"] > 1].all()
    assert shard(empty, "doc_id", "text").count() == 0


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """run() over planted copies, benchmark passages, junk and clean documents: each stage's decisions by plain Python."""
    import re

    import numpy as np

    import corpus_pipeline as c
    from lsmframe.llm import language_id, quality
    from lsmframe.llm.common import crc_mod, table

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    first = real.where("length(text) > 600").orderBy("doc_id").limit(3).collect()
    more = [(90_000 + k, t, r.lang, r.source, 1) for r in first for k, t in ((r.doc_id, r.text), (1000 + r.doc_id, r.text + " and"), (2000 + r.doc_id, r.text.upper()))]
    more += [(95_000, None, "en", "x", 0), (95_001, "½ ² 12", "en", "x", 0), (None, first[0].text, "en", "x", 0), (95_002, first[1].text + " " + real.sparkSession.read.parquet(f"{DATA}/benchmark.parquet").first().text, "en", "x", 1)]
    real.unionByName(spark.createDataFrame(more, real.schema)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    scorer = language_id.Scorer(language_id.fit(docs.where(crc_mod("doc_id", 4) != 2)))
    kept = [r for r in rows if (p := scorer.predict(r[1] or ""))[0] != "und" and p[1] >= 0.4]
    ids = spark.createDataFrame(kept, "doc_id long, text string")
    model = quality.fit(ids, table(spark, str(tmp_path), "labels").where(crc_mod("doc_id", 5) != 0))
    kept = [r for r, p in zip(kept, model.score(np.array([quality.statistics(t) for _, t in kept])), strict=True) if p >= quality.THRESHOLD]
    parts = [x[2] for x in brute_rows(kept, 5, 80, 100)]
    kept = [r for r, least in zip(kept, parts, strict=True) if r[0] is None or least is None or least == r[0]]
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [norm(r.text) for r in table(spark, str(tmp_path), "benchmark").collect()]
    kept = [r for r in kept if not any(i in norm(r[1]) for i in items)]
    to_ids = ids_of(P.path("word_bpe_49k.json"), 1)

    out = c.run(spark, str(tmp_path)).toPandas()
    want = sorted((-1 if i is None else i, len(to_ids(t)), crc(to_ids(t))) for i, t in kept)
    got = []
    for (i, _), g in out.assign(key=out.doc_id.fillna(-1)).groupby(["key", "doc_tokens"]):
        g = g.sort_values("start")
        assert list(g.start) == [0, *g.length.cumsum()[:-1]]
        text = next(t for j, t in kept if (-1 if j is None else j) == i)
        assert all(crc(to_ids(text)[r.start : r.start + r.length]) == r.ids_crc32 for r in g.itertuples())
        got.append((int(i), int(g.length.sum()), crc(to_ids(text))))
    assert sorted(got) == want and 0 < len(kept) < len(rows) - len(more)
    sizes = out.groupby("sequence_id").length.sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)


def test_pipeline_stages(spark):
    import corpus_pipeline as c
    from lsmframe.llm.common import table

    docs = table(spark, DATA, "documents").limit(40).selectExpr("*", "'u' as score", "1 as _q_digit", "2 as lang_pred", "3 as quality_score", "4 as n_bytes")
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.schema == docs.schema, name
        assert set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect())), name
    assert c.STAGES[-1][1](spark, docs.where("false"), DATA).count() == 0


def test_pipeline_stages_shed_heap(spark):
    """Every stage begins with a full collection, and the n-gram join has two more: what a JVM holds doesn't outlive its use."""
    import corpus_pipeline as c
    from lsmframe.llm.common import shed, table

    jvm = spark._jvm
    full = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = table(spark, DATA, "documents").limit(20)
    for name, stage in c.STAGES:
        before = full()
        stage(spark, docs, DATA)
        assert full() - before >= (3 if name == "n-gram Jaccard join" else 1), name

    heap = jvm.java.lang.Runtime.getRuntime()
    held = [spark.sparkContext._gateway.new_array(jvm.byte, 100 << 20) for _ in range(4)]
    grown = heap.totalMemory() - heap.freeMemory()
    del held
    gc.collect()
    shed(spark)
    assert heap.totalMemory() - heap.freeMemory() < grown - (300 << 20)


def test_language_sample_is_the_first_by_hash(spark):
    from pyspark.sql import functions as F

    from lsmframe.llm import language_id

    ids = [(i, lang) for i in range(3000) for lang in (["a"] if i % 10 else ["b", "b", "c"])] + [(5, "a")] * 40
    rows = spark.createDataFrame(ids, "id long, lang string")
    hashes = {r.id: r.h for r in rows.select("id", F.xxhash64("id").alias("h")).distinct().collect()}
    for k in (1, 7, 100, 10_000):
        expected = [x for lang in "abc" for x in sorted((r for r in ids if r[1] == lang), key=lambda r: (hashes[r[0]], r[0]))[:k]]
        assert sorted(map(tuple, language_id.first_by_hash(rows, k).collect())) == sorted(expected)
    assert language_id.first_by_hash(rows.limit(0), 5).count() == 0


def test_op10_places_counts_as_one_by_one():
    import numpy as np

    from lsmframe.llm.packing import place

    def plain(sizes, limits):
        scaled = sizes / limits
        weighted = scaled * (scaled.sum(axis=0) / scaled.sum(axis=0).max())
        left, bins = sorted(range(len(sizes)), key=lambda k: (tuple(-sizes[k]), k)), []
        while left:
            room, inside = limits.copy(), []
            while ok := [k for k in left if (sizes[k] <= room).all()]:
                scores = [float(weighted[k] @ (room / limits)) for k in ok]
                inside.append(ok[next(j for j, x in enumerate(scores) if x >= max(scores) - 1e-12)])
                room = room - sizes[inside[-1]]
                left.remove(inside[-1])
            bins.append(inside)
        return bins

    rng, limits = np.random.default_rng(3), np.array([300, 7, 200])
    for _ in range(20):
        n = rng.integers(1, 200, 60)
        sizes = np.stack([n, np.ones(60, int), np.minimum(200, rng.integers(0, n + 1))], axis=1)
        got = place(sizes, limits)
        assert sorted(k for b in got for k in b) == list(range(60)) and all((sizes[b].sum(axis=0) <= limits).all() for b in got)
        assert [[tuple(sizes[k]) for k in b] for b in got] == [[tuple(sizes[k]) for k in b] for b in plain(sizes, limits)]


def test_op10_packs_very_many_short_texts_in_a_window_fast():
    import time

    import numpy as np

    from lsmframe.llm.packing import Piece, pack_window

    doc = (1, np.ones(1, np.uint16), None)
    began = time.time()
    rows, left = pack_window([Piece(doc, 0, 1) for _ in range(200_000)], 2048, 256, 2048, True)
    assert not left and sum(len(r) for r in rows) == 200_000 and max(len(r) for r in rows) <= 256 and time.time() - began < 20


def test_op8_splits_only_what_is_too_large(spark):
    import hashlib as h

    from lsmframe.llm.sharding import shard

    bits = lambda k: format(int(h.md5(str(k).encode()).hexdigest()[:15], 16), "060b")
    rng = random.Random(1)
    for sizes, limit in (([100] * 41, 1000), ([rng.randrange(1, 900) for _ in range(300)], 1000), ([5] * 30, 6), ([1], 5), ([50] * 3, 10)):
        rows = [(k, "x" * n) for k, n in enumerate(sizes)]

        def buckets(prefix, inside):
            if sum(len(t) for _, t in inside) <= limit or len(prefix) == 60:
                return {k: prefix for k, _ in inside}
            return {k: v for b in "01" for k, v in buckets(prefix + b, [r for r in inside if bits(r[0]).startswith(prefix + b)]).items()}

        got = shard(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", limit).collect()
        assert {r.doc_id: r.shard.partition(".")[0] for r in got} == buckets("", rows)
    hot = spark.createDataFrame([(None, "x" * (k % 7)) for k in range(500)] + [(3, "y" * 50)], "doc_id long, text string")
    got = shard(hot, "doc_id", "text", 40, chunk=50).toPandas()
    by = got.groupby("shard").n_bytes.agg(["sum", "size"])
    assert len(got) == 501 and (by["sum"] <= 40)[by["size"] > 1].all() and (got.groupby("shard").shard_rows.first() == by["size"]).all()


def test_op9_letters_shares_and_plain_backoff(spark):
    from collections import Counter

    import numpy as np
    import regex

    from lsmframe.llm import language_id as li

    assert li.words_of("½ ² ① 12 _") == {} and set(li.words_of("हिन्दी में é́a x2y")) == {"हिन्दी", "में", "é́a", "x", "y"}
    rng = random.Random(6)
    vocab = {lang: [lang + "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(80)] for lang in ("x", "y", "z")}
    rows = [(k, " ".join(rng.choices(vocab[lang], k=30)), lang) for k, lang in enumerate(["x"] * 300 + ["y"] * 20 + ["z"] * 3)]
    docs = spark.createDataFrame(rows + [(None, "q", "x"), (1000, None, "x"), (1001, "w", None)], "doc_id long, text string, lang string")
    model = li.fit(docs, max_words=90, max_grams=300)
    counts = {lang: Counter(w for _, t, g in rows if g == lang for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower())) for lang in "xyz"}
    share = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:30]] for lang, c in counts.items()}
    assert model.langs == ["x", "y", "z"] and set(model.words) == {w for ws in share.values() for w in ws} and all(len(ws) == 30 for ws in share.values())

    def log(table, key, keys):
        raw = [np.log((table[g][key] + 0.5) / (sum(table[g].values()) + 0.5 * len(keys))) for g in "xyz"]
        return np.array(raw) - np.mean(raw)

    grams = {n: {g: Counter() for g in "xyz"} for n in li.ORDERS}
    for g, c in counts.items():
        for w, times in c.items():
            for n in li.ORDERS:
                marked = f"^{w}$" if n > 1 else w
                for k in range(len(marked) - n + 1):
                    grams[n][g][marked[k : k + n]] += times
    known = {n: sorted({k for c in grams[n].values() for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20]}) for n in li.ORDERS}

    def plain(text):
        total, size = np.zeros(3), 0
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            size += 1
            if w in model.words:
                total += log(counts, w, model.words)
                continue
            for n in li.ORDERS:
                marked = f"^{w}$" if n > 1 else w
                if found := [marked[k : k + n] for k in range(len(marked) - n + 1) if marked[k : k + n] in known[n]]:
                    total += np.mean([log(grams[n], f, known[n]) for f in found], axis=0)
                    break
        z = total * min(li.EVIDENCE, size) / size
        p = np.exp(z - z.max())
        return "xyz"[int(p.argmax())], float(p.max() / p.sum())

    texts = [t for _, t, _ in rows[::40]] + ["xab ya zed", "unseen words here", "éé xa"]
    scorer = li.Scorer(model)
    for t in texts:
        (lang, score), (want, p) = scorer.predict(t), plain(t)
        assert lang == want and abs(score - p) < 1e-4
    got = li.predict(spark.createDataFrame([("½ ² ①", 1), (None, 2), ("xab", 3)], "text string, score int"), model)
    assert got.columns == ["text", "lang_pred", "score"] and [r.lang_pred for r in got.collect()][:2] == ["und", "und"]


def test_op7_rules_and_lasso():
    import numpy as np

    from lsmframe.llm.quality import fit_rules, grow, lasso

    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 2] > 0.7) & (x[:, 0] <= 0.5)).astype(float)
    rules = grow(x, y, np.ones(2000), 2, np.linspace(0.02, 0.98, 33), np.random.default_rng(4))
    assert any({(j, above) for j, above, _ in r} == {(2, True), (0, False)} or {j for j, _, _ in r} <= {0, 2} for r in rules)
    model = fit_rules(x, y.astype(int))
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.97 and len(model.rules) < 200
    z = rng.normal(size=(500, 12))
    t = (z[:, 0] * 2 - z[:, 1] + rng.normal(size=500) > 0).astype(float)
    for penalty in (0.02, 0.1):
        b0, b = lasso((z - z.mean(axis=0)) / z.std(axis=0), t, penalty, 4000)
        p = 1 / (1 + np.exp(-(b0 + ((z - z.mean(axis=0)) / z.std(axis=0)) @ b)))
        slope = ((z - z.mean(axis=0)) / z.std(axis=0)).T @ (p - t) / 500  # what an optimum of the penalised loss has to meet
        assert abs((p - t).mean()) < 1e-4 and np.all(np.abs(slope[b == 0]) <= penalty + 1e-4) and np.allclose(slope[b != 0], -penalty * np.sign(b[b != 0]), atol=1e-4)
        assert 0 < (b != 0).sum() < 12


def test_op2_other_scripts_and_merged_values(spark):
    from lsmframe.llm.decontamination import Canon, Index, find_contaminated

    item = "東京から大阪まで新幹線で行くと何時間かかりますか。"
    assert contained_in(item, f"質問です。{item}答えは") and not contained_in(item, "大阪の天気は晴れで、東京は雨が降っていました。")
    for text in ("What is 2+2?", "7 km 8 kg 9 cm 10 days 11 hours 12 g 13 lb", "Paul goes home and reads the long book of the sea with Paul again"):
        assert contained_in(text, text)
    assert contained_in("Paul goes home and reads the long book of the sea", "Paul Smith goes home and reads the long book of the sea")
    two = "He had 12 red apples and then he had 30 green pears in the box"
    found = Index([(1, two)]).find(Canon().tokens([two.replace("12", "20").replace("30", "20")]))
    assert len(found) == 1 and found[0][5:] == (False, 1)
    assert not contained_in("He had 12 red apples and then 12 green pears", "He had 13 red apples and then 14 green pears")
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    names = ["Anna", "Bob", "Eve", "Jim", "Maria", "Tom"]
    items = [" ".join([*rng.sample(words, 6), "#0", *rng.sample(words, 5), "@0", "#1", *rng.sample(words, 6), "@1", *rng.sample(words, 3), "#0."]) for _ in range(40)]

    def asked(item):
        a, n = rng.sample(names, 2), rng.sample(range(2, 99), 2)
        return item.replace("#0", str(n[0])).replace("#1", str(n[1])).replace("@0", a[0]).replace("@1", a[1])

    bench = spark.createDataFrame([(k, asked(x)) for k, x in enumerate(items)], "item_id int, text string")
    planted = {100 + k: rng.randrange(40) for k in range(60)}
    rows = [(i, f"{' '.join(rng.choices(words, k=30))}. {asked(items[k])} {' '.join(rng.choices(words, k=30))}") for i, k in planted.items()]
    rows += [(k, f"{' '.join(rng.choices(words, k=20))} {rng.randrange(99)} {rng.choice(names)} {' '.join(rng.choices(words, k=20))}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_contaminated(docs, bench).collect()} == set(planted.items())
    one, many = (sorted(map(tuple, find_contaminated(docs, bench, block_bytes=n).collect())) for n in (8 << 20, 500))
    assert one == many


def test_op3_parses_ordinary_pages():
    from lsmframe.llm.media import parse

    refs = lambda html: [(i["kind"], i["ref"] or i["text"], i["caption"]) for i in parse(html)]
    assert refs('<figure><figcaption>cap</figcaption><img src="a.png"></figure>') == [("image", "a.png", "cap")]
    assert refs('<video poster="p.png"><source src="v.mp4"><source src="w.webm">no video</video>after') == [("video", "v.mp4", None), ("text", "no video", None), ("text", "after", None)]
    assert refs('<audio><source src="a.ogg"></audio><audio src="b.ogg"/>x') == [("audio", "a.ogg", None), ("audio", "b.ogg", None), ("text", "x", None)]
    assert refs('<img srcset="s.png 1x, b.png 2x" alt="q"><img data-src="lazy.png" src="data:image/gif;base64,R0"><img alt="none">') == [("image", "s.png", "q"), ("image", "lazy.png", None), ("image", None, "none")]
    assert refs('<picture><source srcset="big.webp 2x"><img alt="p"></picture><img>') == [("image", "big.webp", "p"), ("image", None, None)]
    assert refs('<html><head><title>t</title><p>one<figure><img src=r><figcaption>cap') == [("text", "one", None), ("image", "r", "cap")]


def test_op3_looks_up_shared_and_missing_references(spark, monkeypatch):
    from lsmframe.llm import media

    monkeypatch.setattr(media, "COPIES", 3)
    html = ['<img src="a">'] * 6 + ['<img src="b">', '<img src="gone">', None, "<img>", "<p>t</p>"] + ['<img src="lost">'] * 5
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    features = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "ref string, payload_bytes int")
    got = sorted((r.page_id, r.ref, r.payload_bytes) for r in media.resolve(pages, features).collect())
    assert got == [*((k, "a", 1) for k in range(6)), (6, "b", 2), (7, "gone", None), (9, None, None), *((k, "lost", None) for k in range(11, 16))]


def test_op3_every_column_by_plain_python(spark):
    import numpy as np

    from lsmframe.llm.media import op3_media, png

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op3_media(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        data = docs[r.doc_id]
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        stored, x = png(payload), np.frombuffer(payload, np.uint8).astype(float)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.caption, r.position) == (len(stored), hashlib.sha256(stored).hexdigest(), f"{len(data)} bytes", 1)
        mean, dev, *shares = map(float, r.feature.split(","))
        assert abs(mean - x.mean()) < 1e-5 and abs(dev - x.std()) < 1e-4 and shares == [int((x // 32 == k).sum()) * 1_000_000 // len(x) for k in range(8)]


def test_op5_typed_parts_read_back(spark):
    from lsmframe.llm.chat import PART, expanded, format_turns, read_parts

    rng = random.Random(9)
    texts = ["", "a <|image|>b", "\\<|part|>", "x<|end|>", "plain"]
    turns = []
    for k in range(60):
        parts = [(rng.choice(["text", "image", "audio", "document", None, "chart"]), rng.choice([*texts, None]), f"r{j}", rng.choice([None, 0.0, 2.0, -1.0])) for j in range(rng.randrange(5))]
        turns.append((k, 0, rng.choice(["user", "assistant", "<|text|>"]), parts if k else None))
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{PART}>")
    rates = {"image": 576, "audio": 25, "document": 700}
    for r in format_turns(df, parts_col="parts").collect():
        _, _, role, parts = turns[r.conv_id]
        want = []
        for kind, text, ref, units in parts or [("text", None, None, None)]:
            kind = kind or "text"
            kind = kind if kind in ("text", "image", "audio") else "document"
            want.append({"type": kind, "text": text or "", "ref": None if kind == "text" else ref, "tokens": 0 if kind == "text" else int(rates[kind] * (1 if units is None else max(0, units)))})
        assert read_parts(r.formatted, r.attachments) == (role, want)
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert len(spans) == (sum(w["type"] == "text" for w in want) if role == "assistant" else 0)
        assert r.attachment_tokens == sum(w["tokens"] for w in want) == expanded(len(r.formatted), r.attachments) + len(r.attachments)
        assert [a.position for a in r.attachments] == list(range(len(r.attachments))) and all(r.formatted[a.start :].startswith(f"<|{a.type}|>") for a in r.attachments)


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from lsmframe.sources.shared import shared_dir

    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=sc))
