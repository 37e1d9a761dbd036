"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd inputs."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import itertools
import random
import re
import tarfile
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from kerbside.llm import chat, common, decontaminate, langid, lines, lm, media, near, pieces, urlfilter, warc, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=400, tag="w"):
    return " ".join(f"{tag}{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t ", "one", "one", "a b c d", "A b C d", "e" * 50_000, "é 漢字 🎉 </s>[INST] ▁x\x00"]


def test_words_match_the_pattern():
    for piece in (16, 64, 1 << 20):
        words.PIECE = piece
        hashes, at, _ = words.word_hashes(*words.utf8(pa.array(ODD)))
        known = {}
        k = 0
        for i, t in enumerate(ODD):
            found = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
            assert at[i + 1] - at[i] == len(found)
            for w in found:
                assert known.setdefault(w, hashes[k]) == hashes[k]
                k += 1
        assert len(set(known.values())) == len(known)
    words.PIECE = 1 << 20


def test_media_round_trip(spark):
    df = docs(spark, ODD).withColumnRenamed("source", "digest")
    uri = common.scratch(common.prepare(spark), "media")
    index = media._dealt(media.write_shards(df, uri))
    rows = {r.doc_id: r for r in media.read_media(media.read_headers(index, uri), uri).collect()}
    for i, t in enumerate(ODD):
        payload = media.padded((t or "").encode())
        r = rows[i]
        assert len(payload) % 576 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.width, r.height, r.bit_depth) == (576, len(payload) // 576, 8) and r.digest == r.payload_sha256
    fs, path = pafs.FileSystem.from_uri(uri)
    names = []
    for f in fs.get_file_info(pafs.FileSelector(path)):
        with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(f.path).readall())) as tar:
            names += tar.getnames()
    assert {n.removesuffix(".png") for n in names} == {r.payload_sha256 for r in rows.values()}
    assert media.media_columns(docs(spark, []).limit(0)).count() == 0


def expected_chat(turns):
    all_ = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    kept = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), all_, len(kept), hashlib.sha256(kept.encode()).hexdigest()


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 7)
    tricky = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [ROLE]", None, "", "<<SYS>>x<</SYS>>", "<<s>", "\\", "é漢🎉"]
    convs = {1: [("user", t) for t in tricky], 2: [("assistant", t) for t in tricky], 3: [(None, "x"), ("tool\n", "[/ROLE]"), ("system", "s"), ("assistant", "a b")]}
    rows = [(c, i, r, t, 0) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.assemble(chat.encode_segments(df))).collect()}
    for c, turns in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected_chat(turns)
    for t in [*tricky, "".join(chat.CONTROLS)]:
        plain = chat.escape(t or "")
        assert chat.unescape(plain) == (t or "") and not any(c in plain for c in chat.CONTROLS)


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(ids, texts):
    sets, up = [shingles(t) for t in texts], {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize(("hot", "block"), [(6, 2_000_000), (2, 3_000)])
def test_near_components(spark, monkeypatch, hot, block):
    monkeypatch.setattr(near, "HOT", hot)
    monkeypatch.setattr(near, "BLOCK_ALL", block)
    monkeypatch.setattr(near, "BLOCK_ONE", block // 4)
    rng = random.Random(3)
    texts = list(ODD)
    passage = prose(rng, 60, tag="p")
    for _ in range(4):
        base = prose(rng, rng.randrange(5, 200)).split()
        for _ in range(45 if len(base) > 60 else 6):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(copy))
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 10)}" for _ in range(30)]
    got = near.near_components(docs(spark, texts).repartition(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(list(range(len(texts))), texts)


def test_near_components_of_nothing(spark):
    assert near.near_components(docs(spark, []).limit(0)).count() == 0


def distance(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(7)
    items = [prose(rng, rng.randrange(6, 40), tag="q") for _ in range(6)] + ["short", None, ""]
    texts = list(ODD)
    for item in items[:6]:
        for edits in (0, 1, int(len(item) * decontaminate.BUDGET), int(len(item) * 0.3)):
            copy = list(item)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice("zyx")
            texts.append(f"{prose(rng, 9)} {''.join(copy).upper()}\n {prose(rng, 9)}")
            for _ in range(edits):  # then also letters that are missing and letters too many
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice(([], [copy[k], "x"]))
            texts.append(f"{prose(rng, 9)} {''.join(copy)} {prose(rng, 9)}")
    texts += ["a short text", "shorter", "(short)", "ashort short1 _short_"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if item and len(item) < decontaminate.SHORT:
                if re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", t or ""):
                    want[d, i] = 0
            elif item and t and len(t) < 2000:
                n = distance(decontaminate.normal(item), decontaminate.normal(t))
                if n <= int(len(decontaminate.normal(item)) * decontaminate.BUDGET):
                    want[d, i] = n
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    twice = bench.union(bench.withColumn("item_id", F.col("item_id") + 100))
    named = docs(spark, texts).withColumn("item_id", F.lit(1)).withColumn("distance", F.lit(2))
    assert {(r.doc_id, r.item_id % 100) for r in decontaminate.leaks(named, twice).collect()} == set(want)
    assert decontaminate.leaks(docs(spark, []).limit(0), bench).count() == 0
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0


def cut_lines(text):
    """Lines end at breaks and after sentences."""
    out, low, i = [], 0, 0
    while i < len(text):
        j = i
        if text[i] == "\n":
            while j < len(text) and text[j] == "\n":
                j += 1
        elif text[i] in "。！？｡":
            while j < len(text) and text[j] in "。！？｡":
                j += 1
            while j < len(text) and text[j].isspace():
                j += 1
        elif text[i] in ".!?":
            j += 1
            while j < len(text) and text[j].isspace():
                j += 1
            j = i if j == i + 1 else j
        if j > i:
            out.append(text[low:j])
            low = i = j
        else:
            i += 1
    return [*out, text[low:]] if low < len(text) else out


def line_words(line):
    return max(len(line.split()), sum(unicodedata.name(c, "").startswith(("CJK UNIFIED", "HIRAGANA", "KATAKANA")) for c in line))


def repeated_runs(texts, least=10):
    """Per text its lines, and those of every run of `least` words or more that stood in an earlier place."""
    seen, out = {}, []
    for d, t in enumerate(texts):
        own = cut_lines(t or "")
        gone = set()
        size = [0, *itertools.accumulate(map(line_words, own))]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if size[j] - size[i] >= least and own[i].strip() and own[j - 1].strip():
                    body = "".join(own[i:j]).strip()
                    e, past = seen.setdefault(body, (d, j))
                    if e != d or past <= i:
                        gone |= set(range(i, j))
        out.append((own, gone))
    return out


@pytest.mark.parametrize("held", [32 << 20, 400])
def test_line_dedup(spark, monkeypatch, held):
    monkeypatch.setattr(lines, "HELD", held)
    rng = random.Random(5)
    shared = "".join(f"{prose(rng, 8)}. " if k % 2 else f"{prose(rng, 8)}\n" for k in range(14))
    texts = [*ODD, *(f"{prose(rng, 7)}.\n{shared}{prose(rng, 7)}." for _ in range(6)), prose(rng, 80)]
    got = lines.dedup(docs(spark, texts).withColumn("gone", F.lit(1)).withColumn("__row", F.lit(2)).withColumn("c0", F.lit(3)).withColumn("N_lines", F.lit("x")))
    got = {r.doc_id: r for r in got.collect()}
    for i, (own, gone) in enumerate(repeated_runs(texts)):
        assert got[i].text == ("".join(x for k, x in enumerate(own) if k not in gone) if gone else texts[i])
        assert (got[i].n_lines, got[i].removed_lines, got[i].gone, got[i].c0) == (len(own), len(gone), 1, 3)
    assert got[len(ODD) + 1].removed_lines > 0 and got[len(texts) - 1].text == texts[-1]


def test_line_dedup_compares_bytes(spark):
    rng = random.Random(9)
    parts = [f"{prose(rng, 12)}." for _ in range(6)]
    texts = ["   ".join(parts), "\n".join(parts), "\n".join(parts), " ".join(p.upper() for p in parts)]
    got = {r.doc_id: r.text for r in lines.dedup(docs(spark, texts)).collect()}
    # lines of more than MIN_WORDS words are runs of their own, equal whatever ends them; where two lines make a run, what parts them counts
    assert got == {0: texts[0], 1: "", 2: "", 3: texts[3]}
    parts = [f"{prose(rng, 6)}." for _ in range(12)]
    texts = ["   ".join(parts), "\n".join(parts), "\n".join(parts)]
    got = {r.doc_id: r.text for r in lines.dedup(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: ""}


def test_lines_by_bytes_are_those_by_characters():
    rng = random.Random(2)
    marks = [". ", "! \n ", "\n\n", " \n ", "?", "...  ", "。", "！ ", "\u00a0", "\u2003", ".\u3000", "é", "漢字", "ก", "’", " ", "\x1c", "\t"]
    texts = [None, "", "\n", ". ", " a", "a.\n"] + ["".join(rng.choice(marks) if rng.random() < 0.4 else rng.choice("ab .") for _ in range(rng.randrange(60))) for _ in range(400)]
    for some in (texts, [t for t in texts if t and t.isascii()], [""], []):
        found = lines.Lines(pa.array(some, pa.string()).slice(0))
        for d, t in enumerate(some):
            own = [found.bytes[i:j].decode() for i, j in zip(found.low[found.at[d] : found.at[d + 1]], found.high[found.at[d] : found.at[d + 1]], strict=True)]
            assert own == lines.lines(t or "") == cut_lines(t or "")
            assert found.words[found.at[d] : found.at[d + 1]].tolist() == lines.n_words(own)


def test_every_passage_holds_a_chunk():
    rng = random.Random(8)
    for _ in range(300):
        passage = ""
        while len(passage.split()) <= lines.REACH:
            passage += f"{prose(rng, rng.choice((1, 2, 3, 5, 9, 10, 12, 30)))}{rng.choice(('. ', chr(10)))}"
        found = []
        for tag in "ab":
            text = f"{prose(rng, rng.randrange(1, 9), tag=tag)}. {passage}{prose(rng, 3, tag=tag)}."
            cut = lines.Lines(pa.array([None, text, ""]))
            a, b, h = cut.chunks()
            found.append(set(h.tolist()))
            assert all(sum(cut.size[i:j]) >= lines.MIN_WORDS for i, j in zip(a, b, strict=True))
            common_ = [k for k, x in enumerate(h.tolist()) if len(found) == 2 and x in found[0]]
            if len(found) == 2:
                assert common_
                assert set(cut.number[cut.marked(a[common_], b[common_])]) >= set(range(1, len(cut_lines(passage)) + 1))


def test_line_dedup_of_odd_tables(spark):
    assert lines.dedup(docs(spark, []).limit(0)).count() == 0
    long = "One line of ten words and then some more words. " * 3000
    rows = [(None, long), (None, long), (1, long), (1, None), (2, "x " * 12)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and sorted(r.removed_lines for r in got) == [0, 0, 2999, 2999, 3000]
    assert [r.text for r in got if r.doc_id == 1] in (["", None], [None, ""]) and {r.text for r in got if r.doc_id is None} == {long[: len(long) // 3000]}


def test_line_dedup_loses_no_part_of_a_passage(spark):
    rng = random.Random(6)
    passages = [
        f"{prose(rng, 60)}. ",  # one line
        f"{prose(rng, 200)}\n",
        "一二三四五六七八九十甲乙丙丁。",
        "".join(f"{prose(rng, n)}. " for n in (2, 3, 30, 1, 14, 2, 1)),  # short lines at either end
        "".join(f"{prose(rng, 1)}\n" for _ in range(25)),
    ]
    around = [(f"{prose(rng, 3, tag='x')}\n", f"{prose(rng, 4, tag='y')}.") for _ in passages]
    texts = [a + p + b for p in passages for a, b in (around[0], *around[1:3])] + ["same.\n" * 45]
    got = {r.doc_id: r.text for r in lines.dedup(docs(spark, texts)).collect()}
    for k in range(len(passages)):
        assert got[3 * k] == texts[3 * k]
        assert [got[3 * k + j] for j in (1, 2)] == [a + b for a, b in around[1:3]]
    assert got[len(texts) - 1] == "same.\n" * 10


def spread(x):
    """splitmix's finish on whole numbers."""
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) % 2**64
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) % 2**64
    return x ^ (x >> 33)


GOLD = 0x9E3779B97F4A7C15


def naive_ids(library, text, doc, rate, judged=None):
    """Every chunk by itself: always the best adjacent pair that is a piece and not skipped, by score, then from the left."""
    size = library.get_piece_size()
    plain = {library.id_to_piece(i): i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    spell = {int(library.id_to_piece(i)[3:5], 16): i for i in range(size) if library.is_byte(i)}
    out = []
    for place, chunk in enumerate(re.findall(" +[^ ]*|[^ ]+", f" {text}") if text else []):
        key = spread(spread(doc % 2**64 ^ spread(pieces.SEED)) + place * GOLD & (2**64 - 1))
        symbols = []
        for c in chunk:
            c = {" ": "▁", "▁": None}.get(c, c)
            symbols += [c] if c in plain else [b for b in (c or "▁").encode()]
        bounds = list(range(len(symbols) + 1))
        verdicts = {}

        def skipped(span):
            if span not in verdicts:
                i, j, k = span
                verdicts[span] = spread(key ^ ((i | j << 21 | k << 42) * GOLD) % 2**64) < rate * 2.0**64
            return verdicts[span]

        while True:
            best = None
            for k in range(len(symbols) - 1):
                if isinstance(symbols[k], str) and isinstance(symbols[k + 1], str) and (i := plain.get(symbols[k] + symbols[k + 1])) is not None:
                    if not skipped(tuple(bounds[k : k + 3])) and (best is None or -library.get_score(i) < best[0]):
                        best = (-library.get_score(i), k)
            if best is None:
                break
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del bounds[k + 1]
        if judged is not None:
            judged += verdicts.values()
        out += [plain[s] if isinstance(s, str) else spell[s] for s in symbols]
    return out


def sp_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_sentencepiece(monkeypatch):
    library = sp_library()
    plain, varied = pieces.Encoder(rate=0.0), pieces.Encoder()
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["  two  spaces ", "▁▁ ▁", "<s></s><0x41>\n", " ", "x" * 70, "ab" * 600, "漢字é" * 100] + [prose(rng, 50, tag="word") for _ in range(20)]
    whole = varied.encode_many(texts, range(len(texts)))
    for i, t in enumerate(texts):
        for e in (plain, varied):
            assert e.decode(e.encode(t, i).tolist()) == t
        assert varied.encode(t, i).tolist() == whole[0][i].tolist() and whole[1][i] == len(plain.encode(t))
        if len(t) < 600:
            assert varied.encode(t, i).tolist() == naive_ids(library, t, i, pieces.RATE)
        if "▁" not in t and "\x00" not in t:
            assert plain.encode(t).tolist() == library.encode(t)
    for name, value in (("STRETCH", 40), ("BLOCK", 7), ("CELLS", 1 << 6), ("CACHED", 20), ("WIDEST", 16), ("REMEMBERED", 9)):
        monkeypatch.setattr(pieces, name, value)
        pieces.book.cache_clear()
        some = [*range(7), *range(8, 16)]
        assert [i.tolist() for i in pieces.Encoder().encode_many([texts[i] for i in some], some)[0]] == [whole[0][i].tolist() for i in some]
    pieces.book.cache_clear()


def test_sentencepiece_judges_each_occurrence():
    e, word, library = pieces.Encoder(), "internationalization", sp_library()
    own = e.encode_many([word] * 5000, range(5000))[0]
    assert len({tuple(i) for i in own}) > 30  # by document
    judged = []
    assert [i.tolist() for i in own[:600]] == [naive_ids(library, word, i, pieces.RATE, judged) for i in range(600)]
    assert abs(sum(judged) / len(judged) - pieces.RATE) < 0.01 and len(judged) > 5_000
    text = f"{word} " * 400
    ids = e.encode(text, 7).tolist()
    assert len({tuple(w) for w in np.split(ids, np.flatnonzero([e.vocab.pieces[i].startswith(pieces.SPACE) for i in ids]))}) > 20  # by place
    assert ids == e.encode(text, 7).tolist() != e.encode(text, 8).tolist() and ids != pieces.Encoder(seed=1).encode(text, 7).tolist()
    never, always = pieces.Encoder(rate=1e-9), pieces.Encoder(rate=1.0)
    assert never.encode(text).tolist() == pieces.Encoder(rate=0.0).encode(text).tolist()
    assert len(always.encode(word)) == len(word) + 1 and always.decode(always.encode(text)) == text


def test_sentencepiece_of_very_long_chunks(monkeypatch):
    """Chunks without a space: beyond 2^22 symbols, and every bound's hash in plain integers as in arrays."""
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghij漢é", k=1 << 16)) * 80
    e = pieces.Encoder()
    began = time.time()
    ids = e.encode(text[: 1 << 19], 3)
    assert time.time() - began < 30 and e.decode(ids.tolist()) == text[: 1 << 19]
    monkeypatch.setattr(pieces, "_MID", 6)
    monkeypatch.setattr(pieces, "_END", 12)
    assert e.decode(e.encode(text[:5000], 3).tolist()) == text[:5000]
    monkeypatch.undo()
    always = pieces.Encoder(rate=1.0)  # nothing is merged: all that takes long is left out
    assert len(text) > 5_000_000 and always.decode(always.encode(text, 3).tolist()) == text
    i = np.array([*rng.choices(range(1 << 24), k=3000), 0, 5, (1 << 21) - 2, (1 << 21) - 1])
    bounds = pieces.wide_bounds(i, i + 1, i + 2)
    assert [pieces._wide_bounds(k, k + 1, k + 2) for k in i.tolist()] == bounds.tolist() and len(set(bounds.tolist())) == len(set(i.tolist()))
    key = e.dropout.keys(np.array([7], np.uint64), np.array([1]))
    skipped = e.dropout.skips(key, bounds).tolist()
    assert [e.dropout.skips_one(int(key[0]), b) for b in bounds.tolist()] == skipped and 200 < sum(skipped) < 400


def test_sentencepiece_of_odd_rows(spark):
    rows = docs(spark, [*ODD, ODD[-1]]).withColumn("doc_id", F.expr("if(doc_id > 7, null, doc_id)"))
    back = pieces.decode(pieces.encode(rows)).collect()
    assert sorted((r.text, r.decoded) for r in back if r.text is not None) == sorted((t, t) for t in [*ODD[1:], ODD[-1]])
    assert [(r.ids, r.decoded) for r in back if r.text is None] == [(None, None)]
    assert len({tuple(r.ids) for r in back if r.text == ODD[-1]}) == 1 and back[0].source == "s"
    assert pieces.encode(rows.limit(0)).count() == 0
    clash = pieces.decode(pieces.encode(rows.withColumn("IDS", F.lit(1)).withColumn("decoded", F.lit(2))))
    assert sorted(r.decoded for r in clash.collect() if r.text is not None) == sorted([*ODD[1:], ODD[-1]])


def test_language_id(spark):
    rng = random.Random(2)
    roots = {"en": "th ing the and er on", "de": "sch ung der die ein ch", "fr": "eau que les ment ré ai", "es": "ción dad los que rr ña"}
    texts, langs = [], []
    for lang, parts in roots.items():
        for _ in range(60):
            texts.append(" ".join("".join(rng.choices(parts.split(), k=rng.randrange(1, 4))) for _ in range(40)))
            langs.append(lang)
    texts += [None, "", "123 !!"]
    langs += ["en", None, "fr"]
    rows = langid.identify(docs(spark, texts, langs)).withColumn("out", langid.held_out()).collect()
    held = [r for r in rows if r.out and r.text and r.lang in roots and r.doc_id < 240]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id >= 240} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.identify(docs(spark, ["x y"], [None])).collect()} == {"und"}
    alike = docs(spark, ["the thing"] * 5, ["en"] * 5).withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1)).withColumn("h", F.lit(1)).withColumn("bound", F.lit(1))
    assert {(r.lang_pred, r.score, r.bound) for r in langid.identify(alike).collect()} == {("en", 1.0, 1)}
    assert langid.identify(alike.limit(0)).count() == 0
    tied = langid.identify(docs(spark, ["the thing"] * 40, ["de", "en"] * 20)).collect()
    assert len({(r.lang_pred, r.score) for r in tied}) == 1


def test_lm_scoring(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 50)
    rng = random.Random(4)
    texts = [*ODD, *(prose(rng, rng.randrange(1, 80), 60 if i % 2 else 600, tag="a" if i % 3 else "b") for i in range(60))]
    got = {r.doc_id: r for r in lm.score_documents(docs(spark, texts).repartition(3)).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for t in texts]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total = np.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), sum(c.values()))
        assert abs(r.base_score - sum(np.log10(c[w] + 0.1) - total for w in t)) < 1e-6
    assert all(np.isfinite(r.score) and r.score < 0 for r in got.values())
    # the same score by a plain recursion over the trained model, and the chance of each word within its class
    models = []
    trained = lm.baum_welch
    monkeypatch.setattr(lm, "baum_welch", lambda *a: models.append(trained(*a)) or models[0])
    tables = []
    build = lm.build_table
    monkeypatch.setattr(lm, "build_table", lambda *a: tables.append(build(*a)) or tables[0])
    got = {r.doc_id: r.score for r in lm.score_documents(docs(spark, texts).repartition(2)).collect()}
    (model, rising), (table, _) = models[0], tables[0]
    assert len(rising) > 1 and all(b >= a - 1e-6 * abs(a) for a, b in zip(rising, rising[1:], strict=False))
    for i, t in enumerate(texts):
        hashes, _, _ = words.word_hashes(*words.utf8(pa.array([t or ""])))
        classes = [*table.classes(hashes).tolist(), 0]
        alpha, total_ = model.start * model.emit[classes[0]], 0.0
        for o in classes[1:]:
            total_ += np.log10(alpha.sum())
            alpha = (alpha / alpha.sum() @ model.move) * model.emit[o]
        total_ += np.log10(alpha.sum())
        for w, k in zip(tokens[i][:-1], classes, strict=False):
            if k > lm.SINGLES:
                total_ += np.log10(c[w] + lm.WEIGHT) - table.log_mass[k]
        assert abs(got[i] - total_) < 1e-3
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("score", F.lit(2.0))
    assert lm.score_documents(odd).count() == 4 and lm.score_documents(odd.limit(0)).count() == 0


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(0)
    lm_model = lm.first_model(np.full(lm.CLASSES, 1 / lm.CLASSES))
    seqs = [rng.integers(0, lm.CLASSES, n).astype(np.int16) for n in (1, 3, 5)]
    for seq, got in zip(seqs, lm.likelihoods(seqs, lm_model), strict=True):
        a = lm_model.start * lm_model.emit[seq[0]]
        for o in seq[1:]:
            a = (a @ lm_model.move) * lm_model.emit[o]
        assert abs(np.log10(a.sum()) - got) < 1e-9


@pytest.mark.parametrize("steps", [8192, 2])
def test_expected_counts_are_those_of_all_paths(monkeypatch, steps):
    monkeypatch.setattr(lm, "STEPS", steps)
    monkeypatch.setattr(lm, "STATES", 2)
    rng = np.random.default_rng(1)
    move, emit = rng.random((2, 2)), rng.random((lm.CLASSES, 2))
    model = lm.Model(np.array([0.3, 0.7]), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    seqs = [rng.integers(0, 5, n).astype(np.int16) for n in (1, 2, 7, 5, 7, 4)]
    want = [np.zeros(2), np.zeros((2, 2)), np.zeros((lm.CLASSES, 2)), 0.0]
    for seq in seqs:
        chance = {}
        for path in itertools.product(range(2), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, o in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[o, b]
            chance[path] = p
        total = sum(chance.values())
        want[3] += np.log10(total)
        for path, p in chance.items():
            want[0][path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                want[1][a, b] += p / total
            for s, o in zip(path, seq, strict=True):
                want[2][o, s] += p / total
    for x, y in zip(lm.expected(seqs, model), want, strict=True):
        assert np.allclose(x, y, atol=1e-4)


def test_warc(spark):
    html = [None, "", "x", "x", "é" * 3000, "x", "y"]
    urls = ["http://a.b/c", "http://www.A.b:80/c#f", None, "nonsense", "http://user@h.org/", "http://a.b/c", "http://a.b/C?q=1"]
    pages = spark.createDataFrame([(10 - i, u, h, "z") for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, digest string")
    rows = warc.archive(pages.withColumn("revisit", F.lit(1)).withColumn("refers_to", F.lit("x")).withColumn("later", F.lit(2))).collect()
    first = {}
    for i, h in enumerate(html):
        first[h or ""] = min(first.get(h or "", 99), 10 - i)
    for r in rows:
        body = (html[10 - r.page_id] or "").encode()
        own = first[html[10 - r.page_id] or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own == r.page_id else ("revisit", own))
    keys = [warc.order(r.url_key, r.ts, r.page_id) for r in rows]
    assert len(rows) == 7 and keys == sorted(keys)
    assert warc.archive(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "http://a.b/", "same"), (None, None, "same"), (5, "x" * 5000, "same"), (5, "x" * 5000, "same"), (7, "u", "same")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archive(odd).collect()) == [(0, "revisit", 5)] * 2 + [(5, "response", None)] * 2 + [(7, "revisit", 5)]


def test_warc_parses_a_record_once(spark):
    """What deals the ranges out reads stored rows: no plan beyond it holds the reading of archives."""
    plan = warc.archive(spark.range(40).selectExpr("id AS page_id", "concat('https://a.net/', id) AS url", "string(id % 3) AS html"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "rangepartitioning" in plan


def test_short_items_in_scripts_without_spaces(spark):
    texts = ["我爱北京大学图书馆", "a北京大学b", "รักกรุงเทพมาก", "an artful cat", "an art cat", "artx", "1 art."]
    bench = spark.createDataFrame([(1, "北京大学"), (2, "กรุงเทพ"), (3, "art")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    first = min(r.doc_id for r in docs(spark, texts).collect())
    assert {(d - first, i) for d, i in got} == {(0, 1), (1, 1), (2, 2), (4, 3), (6, 3)}


def test_warc_merges_runs_from_disk(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    monkeypatch.setattr(warc, "HELD", 20)
    monkeypatch.setattr(warc, "READ_ROWS", 3)
    monkeypatch.setattr(warc, "FAN_IN", 3)
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, f"http://{rng.choice('abc')}.org/{rng.randrange(9)}", f"h{i % 50}") for i in range(300)], "page_id long, url string, html string").repartition(5)
    rows = warc.archive(pages).collect()
    keys = [warc.order(r.url_key, r.ts, r.page_id) for r in rows]
    assert keys == sorted(keys) and sorted(r.page_id for r in rows) == list(range(300))
    runs = warc._Runs(common.scratch(spark, "runs"), warc.READ)
    rows = [(f"r{rng.randrange(4)}", f"k{rng.randrange(30)}", 1, i, 0, "", "", None) for i in range(100)]  # out of order too
    for r in rows:
        runs.add(r)
    assert len(runs.files) > 4 and list(runs.merge()) == sorted(rows, key=runs.key)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOW)
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_filter(spark):
    urls = [None, "", "x", "http://", "http://NET/", "http://a.net", "http://a.net?x=/en/", "http://m.example.net/en/1", "http://example.net/de/", "http://b.example.com/de/9#t", "http://q.org/fr/", "http://q.org/en/?a=1&b=2", "ftp://a.com://b.net/", "http://exam\nple.org/fr/x"]
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in enumerate(urls * 3)], "page_id long, url string, html string, suffix string")
    rows = urlfilter.judge(pages).collect()
    for r in rows:
        host, path, (rule, verdict) = judged((urls * 3)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    plan = urlfilter.judge(pages)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_suffix_share_leaves_out_a_labelled_urls_own_fold(spark):
    urls = [f"http://h{i}.example.com/{'de' if i % 3 else 'en'}/{i}" for i in range(60)] + [f"http://h{i}.org/{'fr' if i % 2 else 'x'}/" for i in range(40)]
    rows = urlfilter.features(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"))
    got = {r.url: r.suffix_block for r in urlfilter.with_share(rows, urlfilter.suffix_table(rows)).collect()}
    known = [(u, judged(u)[0].rsplit(".", 1)[-1], judged(u)[2][1] == "block", zlib.crc32(u.encode()) % urlfilter.FOLDS) for u in urls if judged(u)[2][1]]
    for u in urls:
        ruled = judged(u)[2][1]
        others = [bad for _, s, bad, f in known if s == judged(u)[0].rsplit(".", 1)[-1] and not (ruled and f == zlib.crc32(u.encode()) % urlfilter.FOLDS)]
        assert got[u] == pytest.approx((sum(others) + 1) / (len(others) + 2))


def test_held_out_urls_are_judged_better_than_by_chance(spark):
    n, right = urlfilter.held_out(common.table(spark, "/root/testdata/sf0.1", "pages")).first()
    assert n > 100 and right > 0.55 * n


def test_trees_learn_the_labels():
    cells = [((a, b, 0, 0, 0, 0), 50, 50 * (a > 2 or b > 1)) for a in range(6) for b in range(4)]
    trees = urlfilter.boost(cells)
    for x, n, bad in cells:
        assert (sum(urlfilter.RATE * urlfilter.value(t, x) for t in trees) > 0) == (bad * 2 > n)
