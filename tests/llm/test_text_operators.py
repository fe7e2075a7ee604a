"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeats, empty tables and
extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from deltaloom.llm import bpe, chat, common, fingerprints, idfiles, mixing, ngram_join, repeats, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, size long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [text(r.randint(60, 200)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = text(r.randint(0, 250))
        if r.random() < 0.3:
            p = r.choice(shared)
            t = t[: r.randint(0, len(t))] + p[r.randint(0, len(p) // 3) :] + t
        if rows and r.random() < 0.25:
            near = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, 3)):
                near[r.randrange(len(near))] = r.choice(words)
            t = " ".join(near)
        rows.append((i, t))
    return [*rows, (900, None), (901, ""), (902, "a" * 3000), (903, "ab " * 900), (None, rows[3][1]), (904, rows[7][1]), (904, rows[7][1]), (905, " \n\t "), (906, "two words"), (907, "two words")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None if k % 7 == 0 else f"s{k % 4}", None, "x", 3) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(4)


def sets(text):
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join_of_ids_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " q"), (3, b + " q"), (4, a + " r"), (1, a)]
    got = sorted(tuple(r) for r in ngram_join.join(frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 1), (4, 1, 3)]
    df = frame(spark, rows).withColumnsRenamed({"lang": "_n", "n_chars": "_first"}).selectExpr("*", "1 AS key", "'m' AS mark", "2 AS row", "3 AS klass", "4 AS root")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["key"], r["mark"]) for r in kept.collect()) == [(1, a, 1, "m"), (1, b, 1, "m")]


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join(spark, block):
    rows = corpus()
    known = [(i, sets(t)) for i, t in rows if i is not None]
    links, root = collections.Counter(), list(range(len(known)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, s) in enumerate(known):
        for b in range(a):
            t = known[b][1]
            if s and t and 5 * len(s & t) >= 4 * len(s | t):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(known):
        least[find(a)].append(i)
    want = sorted((i, min(least[find(a)]), links[a]) for a, (i, _) in enumerate(known))
    got = [tuple(r) for r in ngram_join.join(frame(spark, rows), block).collect()]
    assert sorted(x for x in got if x[0] is not None) == want
    assert [x for x in got if x[0] is None] == [(None, None, 0)]
    assert sum(n for _, _, n in want) > 20
    kept = ngram_join.one_of_each(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({c for _, c, _ in want})


def test_ngram_join_of_nothing(spark):
    assert ngram_join.join(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_mixing(spark):
    rows = corpus()
    df = frame(spark, rows)
    got = mixing.mix(df, per_bucket=10).collect()
    assert len(got) == len(rows)
    total, taken, target = collections.Counter(), collections.Counter(), {}
    longest = max(r["size"] for r in got)
    for r in got:
        key = (r["source_size"], r["target"])
        total[key] += r["size"]
        taken[key] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    budget = sum(total.values())
    assert abs(sum(k[1] for k in total) - budget) < 1e-6 * budget
    assert sum(taken.values()) <= budget
    for (size, goal), n in taken.items():
        assert goal <= 3 * size + 1e-9 and abs(n - goal) <= longest
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(2), per_bucket=1000).collect()), key=str)
    assert mixing.mix(df.limit(0)).collect() == []
    # The mix has each row with its own values, as often as it is taken.
    more = df.selectExpr("*", "1 AS key", "'c' AS copies", "cast(null as int) AS row", "map(1, 2) AS m", "3 AS mark")
    made = mixing.mixed(more)
    copies = made.collect()
    assert made.columns == more.columns and {(r["_key"], r["key"], r["copies"], r["row"], r["mark"], r["m"][1]) for r in copies} == {("x", 1, "c", None, 3, 2)}
    assert sum(len((r["text"] or "").split()) for r in copies) == sum(r["taken"] for r in got)
    of = lambda r: (r["doc_id"], r["source"], r["text"])
    assert {of(r) for r in copies} <= {of(r) for r in df.collect()}
    # Rows alike but for one column keep it.
    two = spark.createDataFrame([(1, "a b c", "s", "A"), (1, "a b c", "s", "B")], "doc_id long, text string, source string, _key string")
    assert sorted(r["_key"] for r in mixing.mixed(two).collect()) == ["A", "B"]


def test_targets_are_filled_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, (5, 2, 1), 3).collect()}
    # 1115 words: a, b and the null source are full at three times their size; c takes what is left.
    assert got == {"a": 30.0, "b": 300.0, None: 15.0, "c": 770.0}


def test_toxicity(spark):
    r = random.Random(3)
    words = ["".join(r.choice("bcdfglmn") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        t = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < 0.2)
        for _ in range(3 if toxic else 0):
            t.insert(r.randrange(len(t)), r.choice(["Stupido,", "idiotu", "trashka"]))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, toxic))
    odd = [f"stupido,{c}idiotu{c}trashka{c}stupido" for c in "\u00a0\u3000\u0085\u2028\x1c\n"]
    odd_rows = [(6000 + k, t) for k, t in enumerate(odd)]
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (None, "x"), *odd_rows])
    marked = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marked)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    assert len(got) == 1203 + len(odd)
    # Other white space than ASCII ends words too, for the score as for the stage.
    assert all(got[i]["predicted"] == 1 for i, _ in odd_rows)
    # Against plain loops over the same model: tokens, segments, evidence and curve.
    for i, t in [*rows[:200], *odd_rows]:
        s = np.array([model.token(p) for p in t.split()])
        best, total, n = toxicity.evidence(model, s)
        z = model.curve[0] + model.curve[1] * np.log1p(best) + model.curve[2] * np.log1p(total)
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and got[i]["segments"] == n
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _, _ in labels)
    right = sum(got[i]["predicted"] == labels[i][2] for i in held) / len(held)
    assert right > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[5000]["score"] == got[5001]["score"] < 0.3
    kept = {x["doc_id"] for x in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, x in got.items() if not x["predicted"]}
    nothing = toxicity.learn(docs, marked.limit(0))
    assert {x["score"] for x in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_segments_are_maximal():
    r = random.Random(5)
    for _ in range(300):
        s = np.array([r.choice([-2.0, -1.0, 1.0, 3.0]) for _ in range(r.randint(1, 12))])

        def brute(a, b, s=s):  # the best, longest-free segment of [a, b), then those left and right of it
            best = max(((s[i:j].sum(), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            i, j = best[3:]
            return [*brute(a, i), best[0], *brute(j, b)]

        assert [x[2] for x in toxicity.segments(s)] == pytest.approx(brute(0, len(s)))


@pytest.mark.parametrize("share, n, words", [(8192, 400, 0), (1, 400, 0), (8192, 150, 40)])
def test_repeats(spark, share, n, words):
    how = {"share": share, "length": n, "words": words}
    rows = corpus(2)
    rows += [(910, rows[20][1])] * 6 + [(None, rows[3][1])]
    seen = collections.Counter()
    raw = [(i, t, (t or "").encode()) for i, t in rows]
    for _, _, b in raw:
        seen.update(b[p : p + n] for p in range(len(b) - n + 1))
    want, texts = collections.Counter(), collections.Counter()
    for i, _, b in raw:
        covered = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                covered[p : p + n] = b"\1" * n
        for m in re.finditer(b"\1+", bytes(covered)):
            if len(b[m.start() : m.end()].split()) < words:
                covered[m.start() : m.end()] = bytes(m.end() - m.start())
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        edges = [0, *(k for k in range(1, len(b)) if covered[k] != covered[k - 1]), len(b)]
        parts = [b[x:y] for x, y in zip(edges, edges[1:], strict=False) if x < y and not covered[x]]
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        want[i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
        texts[i, "".join(x.decode("utf-8", "ignore") for x in parts)] += 1
    # Columns with the operator's own names are left alone.
    df = frame(spark, rows).selectExpr("*", "1 AS phrases", "2 AS partial", "3 AS _id", "4 AS _mark", "5 AS cuts", "6 AS new", "7 AS row")
    assert collections.Counter(map(tuple, repeats.repeats(df, **how).collect())) == want
    cut = repeats.without_repeats(df, **how)
    assert cut.columns == df.columns
    got = cut.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == texts
    assert {(r["_key"], r["phrases"], r["partial"], r["_id"], r["_mark"], r["cuts"], r["new"], r["row"]) for r in got} == {("x", 1, 2, 3, 4, 5, 6, 7)}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert repeats.repeats(df.limit(0)).collect() == []


def test_suffix_order_is_the_strings_order():
    r = np.random.default_rng(1)
    raw = r.integers(97, 99, 3000).astype(np.uint8)
    raw[1000:2000] = raw[:1000]
    at = np.arange(0, 3000 - 400 + 1)
    order = repeats.suffix_order(raw, at)
    strings = [raw[p : p + 400].tobytes() for p in at.tolist()]
    places = {x: k for k, x in enumerate(sorted(set(strings)))}
    assert order.tolist() == [places[x] for x in strings] and len(places) < len(strings)


def test_phrases_cover_each_window_once():
    r = np.random.default_rng(0)
    raw = r.integers(97, 99, 5000).astype(np.uint8)
    offsets = np.array([0, 10, 1000, 1000, 5000])
    row, first, windows, _, _ = repeats.parse(raw, offsets)
    got = sorted((a, b + k) for a, b, w in zip(row, first, windows, strict=True) for k in range(w))
    assert got == [(1, p) for p in range(990 - 399)] + [(3, p) for p in range(4000 - 399)]


def test_id_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rows = sorted(corpus(3, 40), key=lambda x: (x[0] is not None, x[0]))
    rows = [x for k, x in enumerate(rows) if k == 0 or x[0] != rows[k - 1][0]]
    want, start = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = frame(spark, rows)
    folder = common.scratch(spark)
    files = idfiles.write_files(idfiles.encoded(df, vocabulary()), folder, 3000)
    assert len(files) > 2
    assert sorted(map(tuple, idfiles.read_files(spark, files).collect()), key=lambda x: x[1]) == want
    assert idfiles.id_files(df.limit(0), vocabulary()).collect() == []


def test_coder_round_trips_and_finds_damage():
    r = np.random.default_rng(0)
    for ids in (np.zeros(0, np.int64), np.zeros(9000, np.int64), np.full(5000, 49407), r.integers(0, 1 << 20, 5000), np.tile([1, 2, 3, 65535], 2000), r.zipf(1.3, 20000) % 49408):
        data = idfiles.pack(np.array([4, -3]), np.array([len(ids) // 2, len(ids) - len(ids) // 2]), ids.astype(np.int64))
        docs, counts, back = idfiles.unpack(data)
        assert docs.tolist() == [4, -3] and counts.sum() == len(ids) and (back == ids).all()
    assert len(idfiles.pack(np.array([1]), np.array([8000]), np.tile([1, 2, 3, 65535], 2000))) < 800
    broken = bytearray(data)
    broken[-100] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        idfiles.unpack(bytes(broken))
    with pytest.raises(ValueError, match="2\\*\\*20"):
        idfiles.pack(np.array([1]), np.array([1]), np.array([1 << 20]))


def test_arc_versions_and_warc():
    import io

    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello"
    for version in (1, 2):
        data = warc.arc_version_block("x.arc", warc.DATE, version) + warc.arc_record("http://a/ b c", "1997", body, version) + warc.arc_record("http://p", warc.DATE, b"plain\n\n", version, "text/plain")
        found = list(warc.read_arc(io.BytesIO(data)))
        assert [x.fields["URL"] for x in found] == ["filedesc://x.arc", "http://a/ b c", "http://p"] and found[1].body == body
        made = [warc.convert(x) for x in found]
        assert [m.headers["WARC-Type"] for m in made] == ["warcinfo", "response", "resource"]
        assert made[1].headers["WARC-Date"] == "1997-01-01T00:00:00Z"
        assert made[1].headers["WARC-Record-ID"] == warc.convert(found[1]).headers["WARC-Record-ID"] != made[2].headers["WARC-Record-ID"]
        back = list(warc.read_warc(b"".join(m.to_bytes() for m in made)))
        assert [b.block for b in back] == [m.block for m in made]
    with pytest.raises(ValueError, match="declared"):
        list(warc.read_arc(io.BytesIO(data[:-5])))


def test_archives(spark):
    big, small = "<p>é" * 400, "<p>"
    rows = [(1, "http://a", big), (2, None, big), (7, "http://b c", big), (3, "u", small), (4, "u", small), (5, "u", None), (None, "n", big), (8, "h", "x" * 1000), (9, "h", "HTTP/1.1 \r\n\r\n" * 90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 7), 2: ("revisit", 7), None: ("revisit", 7)}
    assert warc.archive(df.limit(0)).collect() == []


def test_fingerprints(spark):
    rows = [x for x in corpus(4, 80) if x[0] not in (904,)]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        changed = fingerprints.edited(t, following)
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(got[i]["near_edited"] - jaccard(sets(t), sets(changed))) < 0.25
        assert abs(got[i]["near_next"] - jaccard(sets(t), sets(following))) < 0.25
    assert got[906]["fingerprint"] == got[907]["fingerprint"]
    a, b = (fingerprints.from_text(got[i]["fingerprint"]) for i in (1, 2))
    assert fingerprints.containment(a, fingerprints.merge(a, b)) == 1.0
    assert fingerprints.fingerprint(frame(spark, rows).limit(0)).collect() == []


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    r = random.Random(1)
    odd = ["".join(r.choice("abcABC '’<|>endoftext1 \n\t\x1c\x85éΣİ中😀́ñ.,;!-") for _ in range(r.randint(0, 60))) for _ in range(300)]
    rows = [*corpus(5, 40), *((2000 + i, t) for i, t in enumerate([*odd, "<|endoftext|>x<|startoftext|>", "IT'S they'll", "a" * 4000, "\x00b"]))]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))] += 1
    df = frame(spark, rows)
    assert collections.Counter(map(tuple, bpe.encode_decode(df, vocabulary()).collect())) == want
    ids = collections.Counter((x["doc_id"], x["n_tokens"], digest(" ".join(map(str, x["ids"]))), x["decoded_sha256"]) for x in bpe.tokenized(df, vocabulary()).collect())
    assert ids == want


def test_bpe_encodes_a_word_once(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdeé") for _ in range(8)) for _ in range(1000)) for _ in range(150)]
    tokenizer, made = bpe.Bpe(vocabulary()), []
    word = tokenizer.word
    monkeypatch.setattr(tokenizer, "word", lambda x: made.append(x) or word(x))
    for _ in range(2):
        for i in range(0, len(texts), 10):
            tokenizer.rows(pa.array(texts[i : i + 10]))
    assert len(made) == len(set(made)) > 140_000  # more than 1 << 17
    monkeypatch.setattr(bpe, "MEMORY", 50)
    small = bpe.Bpe(vocabulary())
    for some in ([texts[0], None, "a\u00a0b <|endoftext|> C"], ["", texts[0][:40]], ["x" + texts[0][:400]]):
        offsets, ids = small.rows(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(x or "", add_special_tokens=False).ids for x in some]


def test_workers_keep_one_operators_memories():
    common.kept("bpe")["x"] = tokenizer = bpe.Bpe(vocabulary())
    assert common.kept("bpe")["x"] is tokenizer and bpe.loaded(vocabulary()) is bpe.loaded(vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array(["a b"])], ["text"])
    assert len(list(common.slices([batch], "text", owner="bpe"))) == 1 and common.kept("bpe")
    assert len(list(common.slices([batch], "text"))) == 1
    assert not common.kept("bpe")


def test_batches_are_bounded_by_bytes(spark):
    limit, many = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 6000) AS text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    before = spark.conf.get(limit)
    try:
        for given, top in ((str(64 << 20), common.BATCH_BYTES), ("1m", 1 << 20)):
            spark.conf.set(limit, given)
            common.ship(spark)
            got = [r["n"] for r in many.mapInArrow(sizes, "n long").collect()]
            assert sum(got) >= 24_000_000 and max(got) < 1.1 * top
    finally:
        spark.conf.set(limit, before)


def test_chat(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    pieces = st.lists(st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "s>", "INST]", "é", "\n", "%"]), max_size=8).map("".join)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(pieces, pieces), max_size=4))
    def back(turns):
        assert chat.parse(chat.template(turns)) == turns
        for _, t in turns:
            assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)

    back()
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", hard), (1, 3, "assistant", None), (2, None, None, "x"), (None, 1, "assistant", hard), (3, 1, "a\nb<|im_end|>", "")]
    rows += [(4, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest(f"user\n{hard}\nassistant\nb\nassistant\n\n") and got[1]["loss_sha256"] == digest("b")
    assert (got[None]["loss_sha256"], got[None]["loss_chars"]) == (digest(hard), len(hard))
    assert got[3]["turns_sha256"] == digest("a\nb<|im_end|>\n\n") and got[4]["n_turns"] == 150
    assert got[4]["loss_sha256"] == digest("".join(f"t{i}" for i in range(1, 150, 2)))
    rewriting = lambda turns: f"{len(turns)} turns: " + chat.template(turns)
    assert chat.conversation(rewriting, [("user", "a"), ("assistant", "b")])[2]
    late = lambda turns: ("early " if 70 <= len(turns) < 80 else "") + chat.template(turns)
    assert chat.conversation(late, [("user", "a"), ("assistant", "b")] * 50)[2]
    assert chat.digests(chat.formatted(df.limit(0))).collect() == []


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 440)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (600, [1.0, 2.0]), (601, [0.5, 0.5]), (700, []), (701, []), (800, [0.0] * 8), (5, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows += [(200, rows[200][1]), (31, rows[31][1]), (31, rows[31][1]), (31, rows[32][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(x) for x in topk.top_k(df, candidates=64).collect()]
    assert sorted(got) == sorted(tuple(x) for x in topk.top_k(df).collect())
    clean = [(i, np.floor(1024 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in rows if e is not None and None not in e and np.isfinite(e).all()]
    want = []
    for q in {i for i, _ in clean if i % 100 == 0}:
        best = sorted((-int(v @ w), i) for j, v in clean if j == q for i, w in clean if i != q and len(w) == len(v))[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).collect() == []
