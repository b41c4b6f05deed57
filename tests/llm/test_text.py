"""Language ID, WARC, LM scoring, importance resampling and chat formatting."""

import gzip
import hashlib
import math
import os
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from helpers import compare, database  # noqa: E402

from plankton.llm import chat, dsir, langid, lmscore, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [None, "", "123 $%", "a", "Ünï", "x" * 200_000, "la la " * 30_000, "\U0001d400\U0001d401 z"]
DOCS = "doc_id long, text string, lang string, p string, id int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 0.5) for r in rows], DOCS)


# Language ID


def test_languages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.expr("left(text, 600)"), "lang").collect()][:80]
    rows += [(1000 + i, t, ["en", None][i % 2]) for i, t in enumerate(ODD)] + [(None, "und hier", "de"), rows[0], rows[0]]
    got = langid.identify(frame(spark, rows)).collect()
    want = brute.languages(rows)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got) == sorted((repr(i), brute.held_out(i), x, round(s, 9)) for (i, _, _), (x, s) in zip(rows, want, strict=True))


def test_languages_equal_sql(spark):
    assert compare(langid.op1_langid(spark, SF), database(SF), langid.OP1_SQL) == 200


def test_nothing_to_learn_from(spark):
    assert langid.identify(frame(spark, [])).count() == 0
    assert [tuple(r)[2:] for r in langid.identify(frame(spark, [(1, "text", None)])).collect()] == [("und", 0.0)]
    kept = langid.keep_identified(frame(spark, [(1, "hello there", "en"), (2, "hello here", "en"), (4, "hello", "en"), (3, "12", "en")]), min_score=0.0)
    assert kept.columns == ["doc_id", "text", "lang", "p", "id", "score"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op1_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


# WARC


def archive(n=12):
    rng = random.Random(1)
    records = [warc.record(str(i), f"http://h/{i}", p := bytes(rng.randrange(256) for _ in range(rng.randrange(9, 900))), hashlib.sha256(p).hexdigest(), None) for i in range(n)]
    return records


def found(data):
    rows = list(warc.salvage(data))
    assert all(a[1] <= b[0] or a[0] == b[0] for a, b in zip(rows, rows[1:]))
    covered = sorted({(r[0], r[1]) for r in rows})
    assert not covered or (covered[0][0] == 0 and covered[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(covered, covered[1:])))
    return [int(r[3]["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")) for r in rows if r[3]], [(r[0], r[1]) for r in rows if not r[3]]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [gzip.compress(r, mtime=0) if packed else r for r in archive()]
    at = np.cumsum([0, *map(len, parts)])
    whole = b"".join(parts)
    assert found(whole) == (list(range(12)), [])
    assert found(b"") == ([], [])
    rest = [i for i in range(12) if i != 4]
    # Not the member's time or the header's free text, which no check covers.
    for where in (0, 12, len(parts[4]) // 2, len(parts[4]) - 6) if packed else (0, 5, len(parts[4]) - 6):
        bad = bytearray(whole)
        bad[at[4] + where] ^= 0xFF
        ids, gaps = found(bytes(bad))
        assert ids == rest and gaps == [(at[4], at[5])]
    cut = whole[: at[4] + 9] + whole[at[5] :]
    ids, gaps = found(cut)
    assert ids == rest and gaps == [(at[4], at[4] + 9)]
    ids, gaps = found(whole[: at[11] + 30])
    assert ids == list(range(11)) and gaps == [(at[11], at[11] + 30)]
    noise = b"\x1f\x8b\x08 no member WARC/1.1\r\nnor record"
    ids, gaps = found(whole[: at[3]] + noise + whole[at[3] :])
    assert ids == list(range(12)) and gaps == [(at[3], at[3] + len(noise))]


def test_salvage_inside_a_member():
    parts = archive()
    at = np.cumsum([0, *map(len, parts)])
    whole = bytearray(b"".join(parts))
    pack = lambda x: gzip.compress(bytes(x), mtime=0)
    other = gzip.compress(warc.record("99", None, b"p", hashlib.sha256(b"p").hexdigest(), None), mtime=0)
    assert found(pack(whole)) == (list(range(12)), [])
    bad = bytearray(whole)
    bad[at[5] - 6] ^= 0xFF
    m = pack(bad)
    assert found(m + other) == ([i for i in range(12) if i != 4] + [99], [(0, len(m))])
    (gap,) = [r for r in warc.salvage(m) if r[2]]
    assert gap[2] == f"block digest differs, bytes {at[4]} to {at[5]} of the member's content"
    m = pack(whole)
    half = len(m) // 2
    for rest, more in ((b"", []), (other, [99]), (m, list(range(12)))):
        ids, gaps = found(m[:half] + rest)
        n = len(ids) - len(more)
        assert 3 < n < 9 and ids == list(range(n)) + more and gaps == [(0, half)]
    ids, gaps = found(m[:-3])
    assert ids == list(range(12)) and gaps == [(0, len(m) - 3)]
    hurt = bytearray(m)
    hurt[len(m) // 2] ^= 0xFF
    ids, gaps = found(bytes(hurt) + other)
    assert ids[:4] == [0, 1, 2, 3] and ids[-1] == 99 and set(gaps) == {(0, len(m))}
    assert found(bytes(hurt) + bytes(hurt) + other)[0] == ids[:-1] * 2 + [99]


def test_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 80
    rows = [(7, "http://a", long), (3, None, long), (9, "http://b\r\nX: y", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 400_000), (8, "WARC/1.1\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "d", "p") for r in rows], "page_id long, url string, html string, digest string, payload string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    out = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert all(r["problem"] is None for r in out) and len(out) == len(rows)
    got = {int(r["record_id"]): r for r in out}
    for i, _, html in rows:
        payload = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", "3") if i in (7, 9) else ("response", None))
        assert r["payload"] == (payload if r["record_type"] == "response" else None)
    assert got[9]["target"] == "http://b%0D%0AX:%20y" and got[3]["target"] is None


def test_archives_have_bounded_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "SMALL", 1000)
    rng = random.Random(2)
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    pages = spark.createDataFrame([(i, "u", noise(rng.choice([10, 900, 5000, 30_000]))) for i in range(120)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    files = [f.stat().st_size for f in tmp_path.glob("w/part-*")]
    assert len(files) > 10 and max(files) < 50_000
    assert {int(r["record_id"]) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()} == set(range(120))


def test_the_query_reports_lost_pages(spark, tmp_path, monkeypatch):
    """A damaged archive on the query's own path is an error that says where the gap is."""
    read = warc.read_archives

    def damaged(spark, path, **more):
        import glob

        name = sorted(glob.glob(f"{path.removeprefix('file://')}/part-*"), key=os.path.getsize)[-1]
        data = bytearray(open(name, "rb").read())
        data[len(data) // 2] ^= 0xFF
        open(name, "wb").write(bytes(data))
        for crc in glob.glob(f"{path.removeprefix('file://')}/.*.crc"):
            os.remove(crc)
        return read(spark, path, **more)

    monkeypatch.setattr(warc, "read_archives", damaged)
    with pytest.raises(warc.Lost, match="50 records were written and 49 read; 1 gaps"):
        warc.op4_warc(spark, SF).collect()


def test_damaged_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}" * 50) for i in range(40)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    (path,) = tmp_path.glob("w/part-*")
    data = bytearray(path.read_bytes())
    start, stop = list(warc.salvage(bytes(data)))[20][:2]
    data[(start + stop) // 2] ^= 0xFF
    os.makedirs(f"{tmp_path}/d")
    (tmp_path / "d/x.warc.gz").write_bytes(bytes(data))
    out = warc.read_archives(spark, f"file://{tmp_path}/d").collect()
    assert sum(r["problem"] is None for r in out) == 39 and sum(r["problem"] is not None for r in out) == 1
    (tmp_path / "d/x.warc.gz").write_bytes(b"")
    assert warc.read_archives(spark, f"file://{tmp_path}/d").count() == 0
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_equals_sql(spark):
    assert compare(warc.op4_warc(spark, SF), database(SF), warc.OP4_SQL) > 0


# LM scoring and importance resampling


def small(n=40):
    rng = random.Random(7)
    out = []
    for i in range(n):
        w = ["sun", "moon", "star", "Tree"] if i % 3 else ["cash", "bank", "coin", "moon"]
        out.append((i, " ".join(rng.choice(w) for _ in range(rng.randrange(1, 40)))))
    return out + [(900, None), (901, "  "), (902, "rare words"), (3, "moon again")]


@pytest.mark.parametrize("frequent,hot,targets", [(0.02, 0.01, range(0, 40, 3)), (1e-5, 1e-4, range(0, 40, 3)), (0.5, 0.5, range(0, 40, 3)), (0.02, 0.01, range(903)), (0.02, 0.01, [])])
def test_language_model_scores(spark, monkeypatch, frequent, hot, targets):
    monkeypatch.setattr(lmscore, "FREQUENT", frequent)
    monkeypatch.setattr(lmscore, "HOT", hot)
    monkeypatch.setattr(lmscore, "TASK_WORDS", 200)
    rows = small() + [(5, None), (None, "moon star star"), (7, "x" * 100_000), (8, "very long " * 20_000)]
    ids = spark.createDataFrame([(i,) for i in targets] + [(0,) for _ in targets][:2] + [(None,)], "doc_id long")
    got = lmscore.score_documents(frame(spark, [(i, t, None) for i, t in rows]), ids).collect()
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute.bigram_scores(rows, set(targets), frequent), strict=True)), key=repr)
    assert len(got) == len(rows)
    rounded = lambda r: tuple(round(x, 7) if isinstance(x, float) else x for x in r)
    assert sorted((rounded(tuple(r)[:4]) for r in got), key=repr) == sorted(map(rounded, want), key=repr)
    assert all(r["score"] == (None if r["n_words"] == 0 else pytest.approx(r["loss_target"] - r["loss_background"])) for r in got)


def test_scores_without_rows_or_targets(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.score_documents(frame(spark, []), none).count() == 0
    assert lmscore.score_documents(frame(spark, [(1, "a b", None)]), none).first()["n_words"] == 2
    assert dsir.resample(frame(spark, []), none).count() == 0


def test_target_list_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "TARGETS", 3)
    ids = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    marked = lmscore.marked(frame(spark, [(i, "a", None) for i in range(20)]), ids, "doc_id", "text", "doc_id")
    assert marked.where("target").count() == 3 and marked.count() == 20


@pytest.mark.parametrize("stored", [False, True])
def test_every_target_is_marked(spark, monkeypatch, stored):
    """More targets than go to all tasks; rows that share an id, rows without one, listed ids twice and null, another type of id."""
    from plankton.llm.common import Scratch

    monkeypatch.setattr(lmscore, "TARGETS", 3)
    rows = [(i, f"t{i}") for i in range(20)] + [(4, "again"), (4, None), (None, "no id"), (None, None)]
    ids = spark.createDataFrame([(i,) for i in [*range(2, 12), 4, 99, None]], "doc_id int")
    got = lmscore.all_marked(frame(spark, [(i, t, None) for i, t in rows]), ids, "doc_id", "text", "doc_id", Scratch(spark, "t") if stored else None)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, t, i in range(2, 12)) for i, t in rows), key=repr)


def test_scores_learn_from_every_target(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "TARGETS", 3)
    monkeypatch.setattr(lmscore, "FREQUENT", 0.02)
    rows = small() + [(None, "moon star star"), (5, None)]
    ids = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    got = lmscore.score_documents(frame(spark, [(i, t, None) for i, t in rows]), ids).collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute.bigram_scores(rows, set(range(0, 40, 3)), 0.02), strict=True)]
    rounded = lambda r: tuple(round(x, 7) if isinstance(x, float) else x for x in r)
    assert sorted((rounded(tuple(r)[:4]) for r in got), key=repr) == sorted(map(rounded, want), key=repr)


def test_model_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "FREQUENT", 0.02)
    from plankton.llm.common import Scratch

    rows = small()
    docs = lmscore.marked(frame(spark, [(i, t, None) for i, t in rows]), spark.createDataFrame([(0,), (3,)], "doc_id long"), "doc_id", "text", "doc_id")
    models, _ = lmscore.train(docs, Scratch(spark, "t"))
    every = sorted({w for _, t in rows for w in brute.words(t)})
    size = len(models.vocab.hashes)
    assert 0 < size < len(every)
    known = [models.vocab.codes(lmscore.word_hashes(w))[0] for w in every]
    words = np.array([lmscore.END, *[int(k) if k != lmscore.OTHER else -(2**63) + i for i, k in enumerate(known)]], np.int64)
    for side in models.sides:
        for h in range(size + lmscore.FIRST):
            # Counts that add up to the history's: here all of them on the first word.
            counts = np.zeros(len(words))
            counts[0] = round(side.history[h] / side.weight)
            p = np.exp(-side.losses((np.int64(h) << lmscore.WORD_BITS) | words, counts, np.zeros(len(words))))
            assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_a_text_that_occurs_twice_scores_apart(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(60)]
    rows = list(enumerate(texts + texts[:5]))
    got = {r["doc_id"]: r["loss_background"] for r in lmscore.score_documents(frame(spark, [(i, t, None) for i, t in rows]), spark.createDataFrame([(50,)], "doc_id long")).collect()}
    assert max(got[i] for i in [*range(5), *range(60, 65)]) < min(got[i] for i in range(5, 50)) - 1


def test_target_like_texts_score_low(spark):
    rows = small(90)
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in lmscore.score_documents(frame(spark, [(i, t, None) for i, t in rows]), ids).collect()}
    assert np.mean([got[i] for i in range(60, 90, 3)]) < np.mean([got[i] for i in range(61, 90, 3)])


@pytest.mark.parametrize("share,few", [(0.1, 10_000), (0.1, 3), (0.0, 3), (1.0, 3)])
def test_resample(spark, monkeypatch, share, few):
    """Buckets, weights, Gumbel keys and the choice, all in plain Python."""
    monkeypatch.setattr(dsir, "FEW", few)
    rows = [r for r in small(200) if r[1] != "moon again"] + [(None, "no id"), (950, "x" * 50_000), (951, "long text " * 9000)]
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    got = {r["doc_id"]: r for r in dsir.resample(frame(spark, [(i, t, None) for i, t in rows]), ids, share=share).collect()}
    buckets = {i: brute.buckets(t, 10_000) for i, t in rows}
    raw, target = [1] * 10_000, [1] * 10_000
    for i, own in buckets.items():
        for b in own:
            raw[b] += 1
            target[b] += i is not None and i in range(0, 60, 3)
    weights = {i: sum(math.log(target[b] / sum(target)) - math.log(raw[b] / sum(raw)) for b in own) for i, own in buckets.items()}
    keys = {i: w - math.log(-math.log(brute.uniform(i, "gumbel"))) for i, w in weights.items()}
    assert all(got[i]["log_weight"] == pytest.approx(weights[i], abs=1e-6) and got[i]["key"] == pytest.approx(keys[i], abs=1e-6) for i in keys)
    k = -(-len(rows) * int(share * 10) // 10)
    best = sorted(keys, key=lambda i: (-keys[i], i is not None, i or 0))[:k]
    assert {i for i, r in got.items() if r["selected"]} == set(best)


def test_resampling_learns_from_every_target(spark, monkeypatch):
    docs, ids = frame(spark, [(i, t, None) for i, t in small()]), spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    want = {r["doc_id"]: r["log_weight"] for r in dsir.resample(docs, ids).collect()}
    monkeypatch.setattr(lmscore, "TARGETS", 3)
    assert {r["doc_id"]: r["log_weight"] for r in dsir.resample(docs, ids).collect()} == pytest.approx(want)


# Chat formatting


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "we<i>rd\\"]), st.text(max_size=30) | st.sampled_from(["</turn>\n", "<turn user>\n", "\\", "\\<", "é😀"]))))
@settings(max_examples=150, deadline=None)
def test_render_is_reversible(turns):
    text, spans = chat.render(turns, frozenset(["assistant"]))
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_spans_and_tokens_meet_by_search():
    starts, ends = np.array([0, 2, 2, 5, 9]), np.array([2, 5, 5, 9, 12])
    mask, loss = chat.intersect(np.array([[1, 3], [6, 6], [8, 10]]), starts, ends)
    assert mask.tolist() == [True, True, True, True, True] and loss == [(1, 3), (8, 10)]
    assert chat.intersect(np.empty((0, 2), int), starts, ends)[1] == []


def test_offsets_are_those_of_another_library():
    from tokenizers import Tokenizer, processors

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    other.post_processor = processors.ByteLevel(trim_offsets=False)
    for text in ["", "a", "é😀 日本語 x\n\n  y", "<|endoftext|> don't \u0301\u200d", "\\### Assistant: </turn> ok", "wörd " * 50]:
        ids, starts, ends = chat.Encoder(chat.TOKENIZER).encode(text)
        want = other.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids and list(zip(starts.tolist(), ends.tolist())) == want.offsets


def conversation(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {c: (len(t), digest("".join(f"{r}\n{s}\n" for r, s in t)), len(x := "".join(s for r, s in t if r == "assistant")), digest(x)) for c, t in out.items()}


@pytest.mark.parametrize("limit", [1 << 16, 5])
def test_conversations(spark, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(chat, "PART_CHARS", limit)
    rows = [(1, 0, "user", "hi <turn x>"), (1, 1, "assistant", "é😀 日本語 </turn>\n \\ end "), (1, 2, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, "assistant", " a\n\n"), (2, None, None, None), (None, 0, "assistant", "n"), (None, 0, "user", "m"), (5, 0, "user", "<|endoftext|>"), (5, 1, "assistant", "<|endoftext|>"), (6, 0, "assistant", "x y " * 3000), (6, 0, "assistant", "x y " * 3000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, loss string")
    made = chat.format_conversations(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(made).collect()}
    assert {c: g[:4] for c, g in got.items()} == conversation(rows)
    # The same from a stored output whose parts lie in another order.
    made.orderBy(F.rand(3)).write.parquet(f"{tmp_path}/made")
    stored = spark.read.parquet(f"{tmp_path}/made").repartition(3)
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(stored).collect()} == got
    for r in made.collect():
        assert len(r["ids"]) == len(r["mask"]) == len(r["starts"])
        inside = [any(x["lo"] < e and s < x["hi"] for x in r["loss"]) for s, e in zip(r["starts"], r["ends"])]
        assert inside == r["mask"]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_the_query(spark):
    got = {r["conv_id"]: tuple(r) for r in chat.op7_chat(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    want = conversation(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {c: g[1:5] for c, g in got.items()} == want
    assert compare(chat.op7_chat(spark, SF), database(SF), chat.OP7_SQL) > 1


def test_scores_equal_sql(spark):
    assert compare(lmscore.op5_lm_score(spark, SF), database(SF), lmscore.OP5_SQL) == 200
