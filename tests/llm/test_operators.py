import collections
import dataclasses
import pathlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import chat, common, decontaminate, exact_dedup, line_dedup, near_dedup, packing, pii, queries, repeats, substring_dedup_bytes, substring_dedup_words, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeats within a text, empties, nulls, and long ones."""
    rnd = random.Random(seed)
    vocabulary = ["alpha", "be", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "κάππα"] + [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, near = text(70), text(120).split()
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "a" * 500), (5, "ab " * 200), (6, passage), (7, text(4000))]
    for d in range(8, n):
        kind = d % 6
        if kind == 0:
            body = text(rnd.randint(1, 200))
        elif kind == 1:
            body = out[rnd.randrange(len(out))][1] or ""
        elif kind == 2:
            copy = near[:]
            for _ in range(rnd.randint(0, 8)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            body = " ".join(copy)
        elif kind == 3:
            body = f"{text(rnd.randint(0, 60))} {passage} {text(rnd.randint(0, 60))}"
        elif kind == 4:
            body = (text(30) + "\n") * 3
        else:
            body = re.sub(" ", lambda m: rnd.choice([" ", "\n", "  "]), out[rnd.randrange(len(out))][1] or "x")
        out.append((d, body))
    rnd.shuffle(out)
    return out


def frame(spark, docs):
    """With extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], SCHEMA).selectExpr("*", "1 AS k", "2 AS d", "3 AS fp", "'x' AS h", "4 AS n_bytes")


def result(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("n_words", "n_removed", "kept_sha256")
NEAR = ("n_shingles", "component_id", "kept")
HITS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
EXACT = ("keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    docs = corpus(seed)
    assert result(substring_dedup_bytes.suffix_dedup(frame(spark, docs)), *BYTES) == brute.suffix(docs)


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup_bytes, "UNITS", dataclasses.replace(substring_dedup_bytes.UNITS, hot=2))
    docs = corpus(3)
    assert result(substring_dedup_bytes.suffix_dedup(frame(spark, docs)), *BYTES) == brute.suffix(docs)


def nul_corpus(seed):
    """Texts with NUL characters that share passages within differing contexts, as UTF-16 read as UTF-8 has them."""
    rnd = random.Random(seed)
    wide = lambda k: "".join(rnd.choice("abhé") + "\0" for _ in range(k))
    passages = [wide(90), "\0" * 40 + wide(60), "".join(rnd.choice("\0\0ab") for _ in range(220)), "\0" * 130]
    return [(d, wide(rnd.randint(1, 60)) + "".join(rnd.choice(passages) + wide(rnd.randint(0, 30)) for _ in range(3))) for d in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_with_nul(spark, seed):
    docs = nul_corpus(seed)
    assert result(substring_dedup_bytes.suffix_dedup(frame(spark, docs)), *BYTES) == brute.suffix(docs)


def test_later_strings_with_nul():
    """Of fragments with NUL bytes, all strings of LENGTH bytes that start earlier too."""
    parts = [text.encode() for _, text in nul_corpus(3)]
    d, a, z = substring_dedup_bytes.later_strings(parts, np.arange(len(parts)), np.zeros(len(parts), np.int64))
    got = [[0, 0] for _ in parts]
    for k, x, y in zip(d.tolist(), a.tolist(), z.tolist(), strict=True):
        got[k] = [got[k][0] + y - x, got[k][1] + 1]
    want = brute.suffix([(k, part.decode()) for k, part in enumerate(parts)])
    assert got == [list(want[k][1:3]) for k in range(len(parts))]


#: Words with equal hashes under the polynomial that proposes candidates.
TWINS = "mmmmmmmmmmmmmmmm", "goreqpdjkrjitikl"


def twin_texts(at):
    """Two texts of 60 words that differ only where the first has one of the twins and the second the other."""
    words = [f"v{k}" for k in range(60)]
    return [" ".join(twin if k in at else w for k, w in enumerate(words)) for twin in TWINS]


def test_equal_hashes_are_not_taken_for_repeats(spark):
    """Contexts, windows and sets whose hashes agree, but not their bytes; true repeats among them are still found."""
    one, two = twin_texts({30})
    assert len(set(common.word_hashes(np.frombuffer("".join(TWINS).encode(), np.uint8), np.array([0, 16]), np.array([16, 32])))) == 1
    docs = [(1, one), (2, two), (3, "x " + two + " y"), (4, "z " + one)]
    assert result(substring_dedup_words.window_dedup(frame(spark, docs)), *WORDS) == brute.windows(docs)
    rnd = random.Random(1)
    for _ in range(5):
        start = "".join(rnd.choice("abcdefgh ") for _ in range(84))
        docs = [(k, start + twin) for k, twin in enumerate(TWINS)] + [(2, "b" + start + TWINS[1] + "c")]
        assert result(substring_dedup_bytes.suffix_dedup(frame(spark, docs)), *BYTES) == brute.suffix(docs)
    docs = list(enumerate(twin_texts(set(range(0, 60, 4)))))
    assert result(near_dedup.near_dedup(frame(spark, docs), size=4), *NEAR) == brute.near(docs)


def test_equal_ranges():
    rnd = random.Random(3)
    data = bytes(rnd.choice(b"ab") for _ in range(3000))
    a = [rnd.randrange(1500) for _ in range(4000)]
    b = [x if rnd.random() < 0.2 else rnd.randrange(1500) for x in a]
    n = [rnd.choice([0, 1, 3, 7, 8, 9, 16, 1200, 1500]) for _ in a]
    got = common.equal_ranges(np.frombuffer(data, np.uint8), np.array(a), np.array(b), np.array(n))
    assert got.tolist() == [data[x : x + k] == data[y : y + k] for x, y, k in zip(a, b, n, strict=True)]


def test_repeats_of_rows_with_one_key(spark):
    """Equal rows are judged as one; different texts of one key as documents of their own; keys need not be numbers."""
    rnd = random.Random(6)
    body = [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(3)]
    rows = [("a", body[0]), ("a", body[0]), ("b", body[1]), ("b", body[2]), (None, body[1]), ("c", "x " + body[0])]
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or "", brute.sha(r[1])))
    for operator, columns, plain in ((substring_dedup_bytes.suffix_dedup, BYTES, brute.suffix), (substring_dedup_words.window_dedup, WORDS, brute.windows)):
        want = plain([(k, t) for k, (_, t) in enumerate(order)])
        got = sorted(((r.doc_id is not None, r.doc_id or "", *(r[c] for c in columns)) for r in operator(spark.createDataFrame(rows, "doc_id string, text string")).collect()))
        assert got == sorted((r[0] is not None, r[0] or "", *want[order.index(r)]) for r in rows)


def test_suffix_array():
    rnd = random.Random(5)
    for letters in (b"ab", b"abc", bytes(range(1, 256))):
        for n in (1, 2, 50, 300):
            text = bytes(rnd.choice(letters) for _ in range(n))
            got = substring_dedup_bytes.suffix_array(np.frombuffer(text, np.uint8), 400)
            assert got.tolist() == sorted(range(n), key=lambda i: text[i:])
            lcp = substring_dedup_bytes.adjacent_prefixes(got, substring_dedup_bytes.word_keys(np.frombuffer(text, np.uint8)), 20)
            for k in range(1, n):
                a, b = text[got[k - 1] :], text[got[k] :]
                same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                assert lcp[k] == min(20, same)


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (2, 3)])
def test_window_dedup(spark, seed, batches):
    docs = corpus(seed)
    assert result(substring_dedup_words.window_dedup(frame(spark, docs), batches=batches), *WORDS) == brute.windows(docs)


def test_index_compacts_and_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup_words.FingerprintIndex.__init__, "__defaults__", (dataclasses.replace(substring_dedup_words.UNITS, hot=2), 1))
    docs = corpus(4)
    assert result(substring_dedup_words.window_dedup(frame(spark, docs), batches=4), *WORDS) == brute.windows(docs)


def test_verification_undoes_equal_hashes(monkeypatch):
    rnd = random.Random(2)
    text = lambda: " ".join(str(rnd.randrange(1000)) for _ in range(60)).encode()
    one, two = text(), text()
    real = substring_dedup_words.later_windows([one, two, one], np.array([1, 2, 3]), np.array([0, 0, 0]))
    monkeypatch.setattr(substring_dedup_words.common, "span_hash", lambda prefix, start, end, powers=None: np.zeros(len(start), np.uint64))
    forced = substring_dedup_words.later_windows([one, two, one], np.array([1, 2, 3]), np.array([0, 0, 0]))
    assert [x.tolist() for x in real] == [x.tolist() for x in forced] == [[3], [0], [60]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_dedup(spark, seed):
    docs = corpus(seed)
    assert result(near_dedup.near_dedup(frame(spark, docs), size=4), *NEAR) == brute.near(docs)


def test_near_dedup_of_hot_groups(spark, monkeypatch):
    """Buckets, classes, components and leads of many rows are dealt over several tasks."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs = corpus(5)
    rnd = random.Random(5)
    words = [f"t{i}" for i in range(60)]
    for d in range(100, 130):
        copy = words[:]
        for _ in range(d % 7):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(99)}"
        docs.append((d, " ".join(copy)))
    docs += [(d, " ".join(words)) for d in range(130, 140)] + [(d, " ") for d in range(140, 150)]
    found = near_dedup.near_dedup(frame(spark, docs), size=4)
    assert result(found, *NEAR) == brute.near(docs)
    strings = near_dedup.near_dedup(frame(spark, docs).withColumn("doc_id", F.format_string("%06d", "doc_id")), size=4)
    assert sorted((int(r.doc_id), r.n_shingles, int(r.component_id), r.kept) for r in strings.collect()) == sorted(tuple(r[c] for c in ("doc_id", *NEAR)) for r in found.collect())


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared in (0.5, 0.8, 0.9):
        got = []
        for _ in range(60):
            n = 500
            both = rng.integers(0, 2**63, int(n * shared), dtype=np.uint64)
            rest = rng.integers(0, 2**63, n - len(both), dtype=np.uint64)
            half = len(rest) // 2
            a, b = (near_dedup.sketch(np.concatenate([both, x])) for x in (rest[:half], rest[half:]))
            got.append((a == b).mean())
        assert abs(np.mean(got) - shared) < 0.03
    assert (near_dedup.sketch(np.array([7], np.uint64)) != np.iinfo(np.uint64).max).all()


ITEMS = [("i1", "alpha beta"), ("i2", None), ("i3", ""), ("i4", "!!"), (None, "w1 w2")]


@pytest.mark.parametrize("block", [200_000, 40])
def test_decontamination(spark, block):
    docs = corpus(2)
    passage = next(t for d, t in docs if d == 6)
    items = [*ITEMS[:4], ("i5", " ".join(passage.split()[5:40]).upper()), ("i6", " ".join(passage.split()[5:40])), ("i7", "delta")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, k int")
    got = {r.doc_id: r for r in decontaminate.find_contamination(frame(spark, docs), bench, block=block).collect()}
    want = brute.contamination(docs, items)
    assert {d: (r.n_words, sum(x.z - x.a for x in r.runs), len(r.items), brute.sha(",".join(r.items)), bool(r.runs)) for d, r in got.items()} == want


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert all(not r.contaminated for r in decontaminate.decontaminate(frame(spark, corpus(1, 12)), bench).collect())


def test_exact_dedup(spark):
    docs = corpus(1)
    assert result(exact_dedup.exact_dedup(frame(spark, docs)), *EXACT) == brute.exact(docs)


def test_exact_dedup_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs = corpus(9) + [(d, "one  text") for d in range(100, 120)] + [(d, None) for d in range(120, 130)]
    assert result(exact_dedup.exact_dedup(frame(spark, docs)), *EXACT) == brute.exact(docs)


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    """All texts of one length share a fingerprint; the chunks still tell them apart."""
    docs = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "ddd")]

    def flat(key):
        import hashlib

        import pyarrow as pa

        def run(batches):
            for b in batches:
                data = [(t or "").encode() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array([1] * len(data), pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data])], names=[key, "fp", "n_bytes", "text_sha256"])
        return run

    monkeypatch.setattr(exact_dedup, "_prints", flat)
    assert result(exact_dedup.exact_dedup(frame(spark, docs)), *EXACT) == brute.exact(docs)


def test_fingerprints_combine():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(3 * exact_dedup.CHUNK + 17))
    a, b = data[:70_001], data[70_001:]
    whole = exact_dedup.fingerprint(data)
    parts = [(0, 0), (0, 0)]
    for k, x in enumerate((a, b)):
        for at in range(0, len(x), 5000):
            piece = x[at : at + 5000]
            parts[k] = exact_dedup.combine(parts[k], exact_dedup.chunk_hash(piece), len(piece))
    both = exact_dedup.combine(parts[0], parts[1], len(b))
    assert (both[0] << 31) | both[1] == whole


def test_chunks_of_huge_texts_are_dealt_out(spark, monkeypatch):
    """Texts over HUGE give the same results by chunks in many tasks."""
    rnd = random.Random(4)
    long = [" ".join(str(rnd.randrange(10_000)) for _ in range(40_000)) for _ in range(2)]
    docs = [(5, long[0]), (3, long[0].replace(" ", "\n")), (4, long[1]), (6, "short"), (7, "short"), (8, " " * 300_000), (9, " "), (2, long[1] + " ")]

    own = exact_dedup._huge_prints(frame(spark, docs).selectExpr("doc_id AS k", "text"), "bigint").collect()
    assert {r.k: r.fp for r in own} == {d: exact_dedup.fingerprint(exact_dedup.normalise(t)) for d, t in docs}
    monkeypatch.setattr(exact_dedup, "HUGE", 100_000)
    assert result(exact_dedup.exact_dedup(frame(spark, docs)), *EXACT) == brute.exact(docs)


def test_few_rows_are_few_files(spark):
    """The files of the rounds that settle components go by the rows, not by the shuffle partitions; labels are the least ones reachable."""
    nodes = spark.createDataFrame([(i, i) for i in range(24)], "v long, c long")
    links = common.cut(spark.createDataFrame([(i, i + 3) for i in range(21)], "a long, b long").coalesce(1))
    folder = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    before = set(folder.glob("rdd-*/part-*"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = near_dedup.components(nodes, links)
        assert {r.v: r.c for r in got.collect()} == {i: i % 3 for i in range(24)}
        assert len(set(folder.glob("rdd-*/part-*")) - before) < 100
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("task_items", [200_000, 8])
def test_packing(spark, task_items):
    docs = [*corpus(1), (100, "<|endoftext|> x<|endoftext|>"), (101, "word " * 5000), (102, "Aa\U00011dbd's \u088f1 \U0001f600x"), (103, "\ua7ce's 12\u0558a")]
    path, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    got = packing.best_fit_packing(frame(spark, docs), path, ranks, public_tokenizers.PATTERN, task_items=task_items).toPandas()
    tokenizer = Tokenizer.from_file(path)
    total = 0
    for d, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at, own = 0, got[got.doc_id == d].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own)))
        assert len(ids) > 2048 or len(own) == 1
        assert (own.length.iloc[1:] == 2048).all()
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for _, own in got.groupby("sequence_id"):
        at = 0
        for r in own.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert got.sequence_id.nunique() <= -(-total // 2048) + (1 if task_items > 1000 else 4)


def test_packing_encoder():
    """The tokenizer's ids, also around long gaps and odd signs, and no memory of the words of earlier texts."""
    path, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    encode, whole = packing.encoder(path, ranks, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    rnd = random.Random(5)
    signs = ["'s", "'re", "'S", " ", "\n", "\x1c", "\x85", "\xa0", "a", "\xe9", "e\u0301", "\u4e2d", "1", "\xb2", "_", "!", "'", "<|endoftext|>"]
    odd = ["".join(rnd.choices(signs, k=rnd.randrange(12))) for _ in range(1000)]
    for text in [*odd, " " * 1_200_000 + "x", "x" + "\n" * packing.LONG_GAP, " " * (packing.LONG_GAP - 1) + "x"]:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    tracemalloc.start()
    for _ in range(100):
        encode(" ".join(str(rnd.random()) for _ in range(300)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 200_000


def test_packing_keeps_tasks_bounded(spark, tmp_path, monkeypatch):
    """Pieces of which no two fit one sequence never meet in one task, whatever their number."""
    real = packing._pack

    def counted(stage, size, keys):
        def run(batches):
            import pathlib
            import uuid

            held = list(batches)
            pathlib.Path(f"{tmp_path}/{stage}-{uuid.uuid4().hex}").write_text(str(sum(b.num_rows for b in held)))
            yield from real(stage, size, keys)(iter(held))
        return run

    monkeypatch.setattr(packing, "_pack", counted)
    items = spark.createDataFrame([(i, 1025 + i) for i in range(400)], "row long, length long")
    got = packing.pack(items, ["row"], task_items=20).collect()
    assert len(got) == len({r.row for r in got}) == len({r.sequence_id for r in got}) == 400
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) < 80


def test_line_dedup(spark):
    rnd = random.Random(1)
    pages = [(i, f"http://Host{i % 3}.org/{i}", "<p>Menu</p><div> home </div>" + "".join(f"<p>{rnd.randrange(40)}</p>" for _ in range(6)) + "<script>x<p>y</p></script>") for i in range(60)]
    pages += [(60, None, "<p>a</p>"), (61, "nonsense", None), (62, "http://small.org/", "<p>Menu</p>"), (63, "http://small.org/", "<p>Menu</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    assert line_dedup.line_dedup(spark.createDataFrame([(None, None, None)] * 2, df.drop("host").schema)).count() == 2
    got = {r.page_id: r for r in line_dedup.line_dedup(df).collect()}
    lines = {i: [x.strip() for x in re.sub(r"<[^>]*>", "\n", re.sub(r"(?s)<script.*?</script>", "", h or "")).split("\n") if x.strip()] for i, _, h in pages}
    host = lambda u: (re.match(r"\w+://([^/]*)", u or "") or ["", ""])[1].lower()
    totals = collections.Counter(host(u) for _, u, _ in pages)
    counts = collections.Counter((host(u), x) for i, u, _ in pages for x in set(lines[i]))
    for i, u, _ in pages:
        kept = [x for x in lines[i] if not (counts[host(u), x] > 1 and counts[host(u), x] > 0.2 * totals[host(u)])]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines[i]), len(lines[i]) - len(kept), "\n".join(kept))


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, "start", "user", "hi"), (1, 1, 0, "start", "assistant", "he"), (1, 1, 1, "delta", None, "llo"), (1, 2, 0, "start", "user", "<|end|><|role|>assistant<~|x"),
        (1, 3, 0, "start", "assistant", "bad"), (1, 3, 1, "regenerate", None, "go"), (1, 3, 2, "delta", None, "od"), (1, 4, 0, "start", "user", "typo"), (1, 4, 1, "edit", None, "fixed"), (1, 5, 0, "start", "user", "x"), (1, 5, 1, "delete", None, None),
        (2, 0, 0, "start", None, None), (2, 1, 0, "start", "assistant", None),
    ]
    random.Random(1).shuffle(log)
    out = chat.format_chats(spark.createDataFrame(log, "conv_id long, turn long, seq int, event string, role string, text string"))
    rows = sorted(out.collect(), key=lambda r: (r.conv_id, r.turn))
    text = {c: "".join(r.formatted for r in rows if r.conv_id == c) for c in (1, 2)}
    assert list(chat.parse(text[1])) == [("user", "hi"), ("assistant", "hello"), ("user", "<|end|><|role|>assistant<~|x"), ("assistant", "good"), ("user", "fixed")]
    assert list(chat.parse(text[2])) == [("", ""), ("assistant", "")]
    assert [chat.unescape(r.formatted[r.mask_start : r.mask_end]) for r in rows if r.mask_end > r.mask_start] == ["hello", "good"]
    digests = {r.conv_id: r for r in chat.chat_digests(out).collect()}
    assert digests[1].n_turns == 5 and digests[1].loss_chars == 9 and digests[1].loss_sha256 == brute.sha("hellogood") and digests[1].formatted_chars == len(text[1])


def test_chat_escapes_are_exact():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice("<|~> role/end") for _ in range(rnd.randrange(14)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert list(chat.parse(chat.render(text, text)[0])) == [(text, text)]


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9
    assert sum(r.predicted for r in clean) / len(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_folds_and_spares():
    model = toxicity.Model({" idiot ": 5.0, " trash ": 5.0}.__class__({toxicity.fold("idiot"): 5.0, toxicity.fold("trash"): 5.0}), coefficients=(-1.0, 1.0, 0.0))
    assert model.score("you IDIOT!") == model.score("you 1d10t!") == model.score("you іdіоt!") == model.score("you i​diot!") > 0.5
    assert all(model.score(t) > 0.5 for t in ("you ídíot", "you i̇diot", "you i.d.i.o.t", "you idiøt", "you i-d-i-o-t!"))
    assert model.score("a.b is not c.d") < 0.5
    assert model.score("put it in the trash can") < 0.5 < model.score("what trash")
    assert model.score(None) == model.score("") == model.score("nice words")


@pytest.mark.parametrize("rows", [[], [(1, 0, 0)], [(1, 0, 1)], [(1, 0, None), (None, 1, 1)]])
def test_toxicity_without_both_labels(spark, tmp_path, rows):
    """Nothing is called toxic, and the pipeline's stage keeps all."""
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect()] == [(0.0, 0)] * 3
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).count() == 3
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_matches_as_a_plain_search_does(monkeypatch):
    """Features against a naive search for each term of the lexicon."""
    rnd = random.Random(1)
    words = ["idiot", "idiots", "trash", "can", "trashy", "you", "the", "clown", "fish", "x"]
    model = toxicity.Model({toxicity.fold("idiot"): 4.0, " tras": 3.5, toxicity.fold("clown"): 5.0})
    for _ in range(300):
        folded = toxicity.fold(" ".join(rnd.choice(words) for _ in range(rnd.randrange(12))))
        spared = [(i, i + len(p)) for p in map(toxicity.fold, model.exceptions) for i in range(len(folded)) if folded.startswith(p, i)]
        hits = [w for t, w in model.terms.items() for i in range(len(folded)) if folded.startswith(t, i) and not any(a <= i <= z - 2 for a, z in spared)]
        total = sum(hits)
        want = (np.log1p(total), np.log1p(100 * total / folded.count(" "))) if len(folded) >= 3 else (0, 0)
        assert np.allclose(model.features(folded), want)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if keep:
                out.append((kind, *m.span()))
    return out


def test_pii_base_spans():
    rnd = random.Random(1)
    for _ in range(8000):
        text = "".join(rnd.choice("1234..@@+a-% ()b2é") for _ in range(rnd.randrange(45)))
        assert pii.base_spans(text) == base(text)
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_pii_field_adds_spans_and_keeps_base(spark):
    texts = [None, "", "please call (650) 253-0000 tomorrow", "ou +1 (269) 555-3296 4524132264652876 an", "mail a.b@c.org or x@y.net", "in 1998 there were 250 of 3 kinds, 2020-10-11", "reach joe [at] corp [dot] com now"]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, list(enumerate(texts)))).collect()}
    assert got[2].spans == "phone:12:26" and got[2].base_spans == ""
    assert "phone:3:20" in got[3].spans and "card:21:37" in got[3].spans
    assert got[4].spans == got[4].base_spans == "email:5:14,email:18:25" and got[4].n_email == 2
    assert got[0].spans == got[1].spans == got[5].spans == ""
    assert got[6].n_email == 1


def test_pii_field_fits_its_table():
    field = pii.trained()
    for example in pii.EXAMPLES:
        tokens, tags = pii._labelled(example)
        assert field.decode([tokens])[0] == tags


def test_pii_spans_in_long_runs():
    """A directory without a pause in its digits: each entry's span is found as it is in a text of its own."""
    rnd = random.Random(1)
    lines = [f"call me at ({rnd.randrange(200, 999)}) 555-{rnd.randrange(10_000):04} tomorrow" for _ in range(300)]
    text = "\n".join(lines)
    begin, want = 0, []
    for line in lines:
        want.append(("phone", begin + 11, begin + 25))
        begin += len(line) + 1
    assert pii.find([text, "", *lines[:3]], pii.trained())[0] == ([], want)
    assert len(pii.windows_of(text)[0]) > 2000


def test_pii_labels_do_not_depend_on_blocks(monkeypatch):
    rnd = random.Random(2)
    windows = [pii.tokens_of(" ".join(re.sub(r"\{\w+:([^}]*)\}", r"\1", rnd.choice(pii.EXAMPLES)) for _ in range(k))) for k in (1, 7, 30, 2)]
    whole = pii.trained().decode(windows)
    monkeypatch.setattr(pii, "BLOCK", 3)
    assert pii.trained().decode(windows) == whole == [pii.trained().decode([w])[0] for w in windows]


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_conversations_and_documents(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string, h int")
    assert chat.chat_digests(chat.format_chats(chat.turns_as_events(turns.drop("h")))).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", None)], turns.drop("h").schema)
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.chat_digests(chat.format_chats(chat.turns_as_events(nulls))).collect()} == {None: (1, 0), 1: (1, 0)}
    bench = spark.createDataFrame([(1, "a b"), (None, None)], "item_id long, text string")
    assert decontaminate.decontaminate(spark.createDataFrame([], EMPTY), bench).count() == 0
    rows = spark.createDataFrame([(None, "x a b"), (1, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.decontaminate(rows, bench).collect()} == {None: (3, 2), 1: (0, 0)}


@pytest.mark.parametrize("operator", [
    substring_dedup_bytes.suffix_dedup, substring_dedup_words.window_dedup, near_dedup.near_dedup, exact_dedup.exact_dedup, pii.find_pii,
    lambda d: packing.best_fit_packing(d, *map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN),
])
def test_empty_tables_and_null_keys(spark, operator):
    assert operator(spark.createDataFrame([], EMPTY)).count() == 0
    rows = [(None, "a b c d e f " * 30), (1, "a b c d e f " * 30), (1, "a b c d e f " * 30), (2, None)]
    assert operator(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def test_repeats_marks_across_batches():
    """A group that spans batches is marked as in one batch."""
    import pyarrow as pa

    rnd = random.Random(1)
    for strict in (False, True):
        units = dataclasses.replace(substring_dedup_bytes.UNITS, strict=strict)
        rows = sorted((rnd.randrange(4), rnd.randrange(4), rnd.randrange(6), (rnd.randrange(100, 500) << 16) | (9 << 8) | 100, rnd.randrange(2), rnd.random() < 0.3) for _ in range(200))
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], names=["h", "c", "d", "q", "more", "old"])
        marks = lambda size: {tuple(r.values()) for b in repeats._mark(units)(iter([batch(rows[i : i + size]) for i in range(0, len(rows), size)])) for r in b.to_pylist()}
        assert marks(200) == marks(7) == marks(1)


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.collect()}
        if name == "exact_dedup":
            assert kept == {d for d, v in brute.exact(rows).items() if v[2]}
        elif name == "minhash_near_dedup":
            assert kept == {d for d, v in brute.near(rows, size=5).items() if v[2]}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert kept == {d for d, v in brute.contamination(rows, items).items() if not v[4]}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_takes_repeated_rows_once(spark):
    rows = [(1, "some words here"), (1, "some words here"), (2, "other words here"), (None, None)]
    out = corpus_pipeline.exact_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2]


def test_pipeline_judges_rows_with_null_and_shared_ids(spark, tmp_path):
    """Verdicts hold for rows: a null id keeps none, and a kept row keeps no other one of its id."""
    item = "these are the very words of an item of the benchmark which no text may hold"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")

    def kept(stage, rows):
        out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
        assert out.columns == ["doc_id", "text"]
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    assert kept(corpus_pipeline.exact_dedup_stage, [(0, "y"), (1, "x"), (1, "y"), (None, "z"), (None, "z"), (None, "v"), (5, "z")]) == [(0, "y"), (1, "x"), (None, "v"), (None, "z")]
    assert kept(corpus_pipeline.near_dedup_stage, [(2, one), (3, two), (3, one + " c"), (None, "d " + two), (None, two + " d")]) == [(2, one), (None, "d " + two)]
    assert kept(corpus_pipeline.decontamination_stage, [(None, item), (None, "e"), (1, "f " + item), (1, "f"), (2, "g"), (3, item)]) == [(1, "f"), (2, "g"), (None, "e")]


def test_registered():
    names = list(queries.queries())
    assert names == sorted(names, key=lambda n: int(n[2:].split("_")[0])) and len(names) == 10


def test_viterbi_is_the_best_of_all_labellings():
    """On short windows, against every sequence of labels."""
    import itertools

    field = pii.trained()
    for text in ("call +1 5", "a @ b", "10.0 x"):
        window = pii.tokens_of(text)[:4]
        emissions, _ = field._emissions([window], 0, len(window))
        size = len(pii.LABELS)

        def score(labels, e=emissions[0]):
            if pii.LABELS[labels[0]][0] == "I":
                return -np.inf
            return sum(e[t, y] for t, y in enumerate(labels)) + sum(field.transition[x, y] for x, y in itertools.pairwise(labels))

        best = max(score(y) for y in itertools.product(range(size), repeat=len(window)))
        assert np.isclose(score(field.decode([window])[0]), best)
