"""Operators on documents against plain versions, and their edges."""

import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltstream.llm import contamination, language, packing, passages, simhash, toxicity
from siltstream.llm.shared import components, shared_folder

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (None, "one two three four"), (4, "one")]


# --- packing


def ids_of(text):
    tokenizer = Tokenizer.from_file(packing.WORD_BPE)
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_packed(rows, pieces, length=packing.LENGTH):
    want = sorted((d is None, d or 0, ids_of(t).tobytes()) for d, t in rows)
    docs = {}
    for p in pieces:
        assert p.length * 4 == len(p.ids)
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    whole = []
    for (doc, tokens), parts in docs.items():
        copies = sum(start == 0 for start, _ in parts)
        assert sum(len(ids) for _, ids in parts) == 4 * tokens * copies
        text = b"".join(ids for _, ids in sorted(parts)) if copies == 1 else sorted(parts)[0][1]
        whole += [(doc is None, doc or 0, text)] * copies
    assert sorted(whole) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or at & (at - 1) == 0 and at < length


def test_packing(documents, prose, rng):
    rows = [(k, prose(rng.randrange(1500))) for k in range(120)] + [(500, prose(6000)), (501, "ça n’est 12½ 日本 x's"), *EDGES]
    check_packed(rows, packing.pack(documents(rows).repartition(3)).collect())


def test_packing_with_few_open_windows(documents, prose):
    rows = [(k, prose(40)) for k in range(60)]
    check_packed(rows, packing.pack(documents(rows).coalesce(1), length=256, most_open=4).collect(), 256)


def test_level_that_keeps_the_sum_of_squares_least():
    levels = packing.Levels(10)
    for size in (3, 6, 4, 7, 3, 2, 8, 5, 5, 1, 9, 4, 4, 2):
        before = levels.count.copy()
        levels.place((0, 0, b"", 0), size)
        sums = []
        for level in [0, *np.flatnonzero(before[: 10 - size + 1])]:
            counts = before.copy()
            if level:
                counts[level] -= 1
            if level + size < 10:
                counts[level + size] += 1
            sums.append((counts**2).sum())
        assert (levels.count**2).sum() == min(sums)


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_groups(marks, near):
    """Smallest id of each id's group; ids whose marks are near hang together."""
    group = {k: k for k in marks}
    while True:
        moved = False
        for a in marks:
            for b in marks:
                if near(marks[a], marks[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    moved = True
        if not moved:
            return group


def test_simhash(documents, prose, rng):
    base = [prose(60).split() for _ in range(8)]
    rows = []
    for k in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = "changed"
        rows.append((k, " ".join(words).title() if k % 2 else " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \x0b"), (203, "Ünder one"), (204, "a b c d\x0ce")]
    marks = {k: plain_fingerprint(t) for k, t in rows}
    groups = plain_groups(marks, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(documents(rows)).collect()}
    assert got == {k: (f"{marks[k]:016x}", groups[k]) for k in marks}
    kept = simhash.one_of_each(documents(rows + rows[:1]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))
    assert kept.columns == documents(rows).columns


def test_ring_keys_and_chains_lose_no_pair(spark, rng):
    values = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(5)):
            b ^= 1 << rng.randrange(64)
        values.append((a, b))
    signed = [tuple(v - (1 << 64) if v >> 63 else v for v in pair) for pair in values]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(signed, "a long, b long")
    meet = F.size(F.array_intersect(simhash.ring_keys(F.col("a")), simhash.ring_keys(F.col("b")))) > 0
    for (a, b), row in zip(signed, rows.select(meet.alias("meet")).collect()):
        near = ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
        assert row.meet or not near
        assert simhash.ring_links([a, b])[0, 1] == (near and a != b) or a == b


def test_a_large_bucket_is_cut_into_cells(spark):
    from siltstream.llm.buckets import cells, linked

    rows = spark.createDataFrame([(1, k) for k in range(200)], "key long, bits long")
    dealt = cells(rows, ["key"], "bits", block=16)
    assert max(r["count"] for r in dealt.groupBy("i", "j").count().collect()) < 80
    near = linked(dealt, ["key"], "bits", "bits", lambda v: np.abs(np.subtract.outer(v, v)) == 1)
    found = components(near).collect()
    assert {r.node for r in found} == set(range(200)) and {r.component for r in found} == {0}


def test_components(spark, rng):
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    links += [(7, 7), (None, 3)]
    marks = {k: k for pair in links if None not in pair and pair[0] != pair[1] for k in pair}
    linked = {frozenset(pair) for pair in links}
    groups = plain_groups(marks, lambda a, b: frozenset((a, b)) in linked)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == groups and len(found) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language


def test_language(documents):
    english = "the quick brown fox jumps over the lazy dog and then it runs away from the house"
    german = "der schnelle braune fuchs springt über den faulen hund und läuft dann vom haus weg"
    rows = [(k, english if k % 2 else german) for k in range(40)]
    table = documents(rows)
    from pyspark.sql import functions as F

    table = table.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    profiles = language.learn(table)
    assert profiles.languages == ["de", "en"]
    asked = documents([(1, "where is the dog"), (2, "der hund und das haus"), (3, "12 !?"), *EDGES])
    got = language.predict(asked, profiles).collect()
    assert [r.lang_pred for r in got[:3]] == ["en", "de", "und"] and len(got) == 3 + len(EDGES)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} >= {"und"}
    assert got[0].held_out == (zlib.crc32(b"1") % 4 == 2)
    assert language.learn(documents([])).languages == []
    assert {r.lang_pred for r in language.predict(asked, language.Profiles({})).collect()} == {"und"}


def test_only_letters_make_a_language_or_a_word(documents):
    from siltstream.llm.words import Words

    profiles = language.Profiles({"b": language.ranked(*language.grams("the dog")), "a": np.zeros(0, np.int64)})
    asked = documents([(1, "\U0001f600 \U0001f680"), (2, "！？（），"), (3, "½ ¾ ²"), (4, "\U0001f600the dog\U0001f600")])
    got = language.predict(asked, profiles).collect()
    assert [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3 and got[3].lang_pred == "b"
    assert [g.tolist() for g in language.grams("dog\U0001f600")] == [g.tolist() for g in language.grams("dog")]
    assert (Words("the dog\U0001f680！", letters=True).hashes == Words("the dog", letters=True).hashes).all()
    assert (language.grams("日本")[0] > 0).any() and len(Words("日本 ½", letters=True)) == 2


def plain_distance(text, other, most=language.RANKED):
    from collections import Counter

    def ranks(t):
        grams = Counter()
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            word = f" {word} "
            for n in (1, 2, 3):
                grams.update(g for k in range(len(word) - n + 1) if (g := word[k : k + n]).strip() and (n < 3 or g[1] != " "))
        def number(g):
            codes = [0 if c == " " else ord(c) for c in g]
            value = sum(c << 21 * k for k, c in enumerate(reversed(codes)))
            return value + (1 << 62 if len(g) == 2 else 0)
        return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], number(x[0])))][:most]

    mine, theirs = ranks(text), ranks(other)
    return sum(min(most, abs(k - theirs.index(g))) if g in theirs else most for k, g in enumerate(mine))


def test_out_of_place_distance(prose):
    a, b = "Der Hund läuft, der Hund bellt. Über 3 x", "The dog runs; the dog's bark über all"
    profiles = language.Profiles({"b": language.ranked(*language.grams(b))})
    assert profiles.distances(language.ranked(*language.grams(a)))[0] == plain_distance(a, b)


# --- repeated passages


def test_repeats(documents, prose):
    shared, line = prose(60), prose(30)
    edited = line.split()
    edited[0] = "other"
    rows = [
        (1, f"{prose(50)} {shared} {prose(20)}"),
        (2, f"{prose(33)} {shared} {prose(47)}"),  # in the middle of other text
        (3, f"{prose(40)}\n{line}\n{prose(40)}"),
        (4, f"{prose(40)}\n{' '.join(edited)}\n{prose(40)}"),  # a near paragraph
        (5, f"{prose(40)}\nshort line\n{prose(300)}"),
        (6, f"{prose(40)}\nshort line"),
        (7, "word " * 200),  # repeats itself
        (9, None), (10, ""), (11, " \n "), (None, shared), (2, None),
    ]
    table = documents(rows)
    found = passages.repeats(table).collect()
    assert {r.doc_id for r in found if r.kind == "passage"} - {7} == {2}
    assert {(r.doc_id, r.kept_doc_id) for r in found if r.kind == "paragraph"} == {(4, 3)}
    texts = {i: t for i, t in rows if t}
    for r in found:
        assert texts[r.doc_id][r.start : r.end].split()
    cut = {r.doc_id: r for r in passages.cut_out(table, passages.repeats(table)).collect() if r.doc_id not in (None, 2)}
    assert cut[1].text == rows[0][1] and cut[5].text == rows[4][1] and cut[6].text == rows[5][1]
    assert " ".join(edited) not in cut[4].text and cut[4].n_chars == len(cut[4].text)
    assert cut[4].text.split("\n") == [rows[3][1].split("\n")[k] for k in (0, 2)]
    assert cut[7].text.startswith("word word") and 9 in cut and 10 in cut and 11 in cut
    rest = passages.cut_out(table, passages.repeats(table)).where("doc_id = 2 and text is not null").first().text
    assert shared not in rest and len(rest.split()) < 80 + 2 * passages.SPAN
    assert passages.repeats(documents([])).count() == 0


def test_every_long_run_is_found_wherever_it_stands(prose, rng):
    from siltstream.llm.words import Words, grams

    shared = prose(passages.PASSAGE + passages.SPAN)
    for _ in range(200):
        cuts = []
        for _ in range(2):
            hashes = Words(f"{prose(rng.randrange(60))} {shared} {prose(rng.randrange(60))}").hashes
            starts = passages.passage_starts(hashes, passages.PASSAGE, passages.SPAN)
            cuts.append(set(grams(hashes, passages.PASSAGE)[starts].tolist()))
        assert cuts[0] & cuts[1]


def test_shared_runs_are_cut_from_their_first_word_to_their_last(documents, prose, rng):
    rows, want = [], {}
    for k in range(12):
        shared = prose(rng.randrange(48, 160))
        before, after = prose(rng.randrange(60)), prose(30)
        rows += [(k, f"{prose(40)} {shared} {prose(20)}"), (100 + k, f"{before} {shared} {after}".strip())]
        want[100 + k] = f"{before}\n{after}".strip()
    table = documents(rows)
    got = {r.doc_id: r.text for r in passages.cut_out(table, passages.repeats(table)).collect()}
    assert got == dict(rows[::2]) | want


def test_near_paragraphs_are_found_by_their_bands(prose, rng):
    from siltstream.llm.words import Words, grams

    missed = 0
    for _ in range(200):
        words = prose(60).split()
        other = list(words)
        other[rng.randrange(60)] = "changed"
        sets, bands = [], []
        for text in (" ".join(words), " ".join(other)):
            w = Words(text)
            sets.append(np.unique(grams(w.hashes, 5)).view(np.int64).tolist())
            bands.append(passages.band_hashes(*passages.shingles(w, *passages.paragraphs(w, 20)))[0])
        a, b = map(set, sets)
        near = len(a & b) >= 0.8 * len(a | b)
        assert passages.jaccard_links(sets, 0.8)[0, 1] == near
        missed += near and not (bands[0] == bands[1]).any()
    assert missed <= 3


def test_rows_that_share_an_id_stand_for_themselves(documents, prose):
    copied, unique, shared, other = prose(200), prose(200), prose(70), prose(200)
    rows = [(1, copied), (2, copied + " end"), (2, unique), (2, unique), (3, other), (3, other + " end")]
    left = [(r.doc_id, r.text) for r in simhash.one_of_each(documents(rows)).collect()]
    assert sorted(left[:], key=str) == sorted([(1, copied), (2, unique), next(x for x in left if x[0] == 3)], key=str)
    rows = [(1, f"{prose(50)} {shared} {prose(50)}"), (2, f"{prose(60)} {shared} {prose(60)}"), (2, unique)]
    table = documents(rows)
    cut = passages.cut_out(table, passages.repeats(table)).collect()
    assert {r.text for r in cut if shared not in r.text} >= {unique} and len(cut) == 3
    assert sum(shared in r.text for r in cut) == 1


def test_texts_are_read_together_as_each_alone(prose):
    from siltstream.llm.words import Words, read_together

    texts = [prose(k) for k in (0, 300, 1, 47, 48, 60)] + ["", " \n ", "ΟΔΟΣ", "İ ΟΔΟΣ", "a\r\nb\n" * 40, "word " * 90]
    parts = list(read_together(texts, 1000))
    assert 1 < len(parts) < len(texts) and [t for part in parts for t in texts[part]] == texts
    words = Words(texts)
    together = passages.passage_starts(words.hashes, passages.PASSAGE, passages.SPAN, words.counts)
    lines = passages.paragraphs(words, 20)
    for k, text in enumerate(texts):
        alone, first, end = Words(text), words.firsts[k], words.firsts[k] + words.counts[k]
        assert alone.hashes.tolist() == words.hashes[first:end].tolist()
        assert alone.starts.tolist() == (words.starts[first:end] - words.begins[k]).tolist()
        starts = passages.passage_starts(alone.hashes, passages.PASSAGE, passages.SPAN)
        assert starts.tolist() == [s - first for s in together if first <= s < end]
        heads, counts = passages.paragraphs(alone, 20)
        mine = (lines[0] >= first) & (lines[0] < end)
        assert (heads.tolist(), counts.tolist()) == ((lines[0][mine] - first).tolist(), lines[1][mine].tolist())


def plain_runs(hits):
    out = []
    for hit in sorted(hits, key=lambda h: (*h[:4], h[4] - h[6], h[4])):
        doc, text, kept, kept_text, start, end, kept_start, kept_end = hit
        last = out[-1] if out else None
        if (
            last
            and last[:4] == list(hit[:4])
            and last[4] - last[6] == last[5] - last[7] == start - kept_start == end - kept_end
            and start <= last[5]
            and ((doc, text) != (kept, kept_text) or last[4] >= kept_end)
        ):
            last[5], last[7] = end, kept_end
        else:
            out.append(list(hit))
    return sorted(out)


def test_passages_that_hang_together_are_one_hit(rng):
    names = ["doc_id", "text_hash", "kept_doc_id", "kept_text", "start", "end", "kept_start", "kept_end"]
    for _ in range(60):
        hits = set()
        for _ in range(rng.randrange(80)):
            start, far, odd = rng.randrange(60), rng.choice([4, 9, 30]), rng.random() < 0.1
            own = (rng.randrange(2), rng.randrange(2))
            kept = own if rng.random() < 0.6 else (rng.randrange(2), rng.randrange(2))
            hits.add((*own, *kept, start + far, start + far + 8, start, start + 8 + odd))
        hits = list({(*h[:5], h[6]): h for h in hits}.values())
        columns = {name: np.array([h[k] for h in hits], np.int64) for k, name in enumerate(names)}
        order, heads, tails = passages.runs_of_hits(columns, columns["doc_id"] * 2 + columns["text_hash"])
        last = {"end", "kept_end"}
        found = [columns[name][order[tails if name in last else heads]].tolist() for name in names]
        assert sorted(map(list, zip(*found))) == plain_runs(hits)


# --- benchmark leaks


def plain_tiles(text, pattern, least):
    in_text, in_pattern, out = [False] * len(text), [False] * len(pattern), []
    while True:
        best, found = least - 1, []
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not in_pattern[p + n] and not in_text[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, t)]
                elif n == best and n >= least:
                    found.append((p, t))
        if best < least:
            return sorted(out, key=lambda t: t[1])
        for p, t in found:
            if not any(in_pattern[p : p + best]) and not any(in_text[t : t + best]):
                in_pattern[p : p + best] = in_text[t : t + best] = [True] * best
                out.append((t, p, best))


def test_greedy_string_tiling(rng):
    for _ in range(150):
        pattern = [rng.choice("abc") for _ in range(rng.randrange(25))]
        text = [rng.choice("abc") for _ in range(rng.randrange(40))]
        if pattern and rng.random() < 0.5:
            cut = rng.randrange(len(pattern))
            text[7:7] = [*pattern[cut:], "x", *pattern[:cut]]
        found = list(contamination.Seeds([(1, " ".join(pattern))]).tiles(" ".join(text)))
        assert (found[0][2] if found else []) == plain_tiles(text, pattern, 5)


def test_leaks(spark, documents, prose):
    item = prose(40)
    words = item.split()
    reordered = " ".join(words[20:]) + " between " + " ".join(words[:20])
    half = " ".join(words[:20])
    rows = [(1, f"{prose(30)} {item.upper()}, {prose(10)}"), (2, f"{prose(9)} {reordered} {prose(5)}"), (3, f"{prose(30)} {half} {prose(30)}"), (4, prose(200)), *EDGES]
    items = [(10, item), (11, None), (12, ""), (13, "too short"), (14, prose(30))]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    for block in (contamination.BLOCK_CHARS, 150):  # in one block or in several
        found = contamination.tilings(documents(rows), benchmark, block_chars=block).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(1, 10), (2, 10)}
        assert all(r.covered == r.item_words == 40 and r.coverage == 1 for r in found)
    assert contamination.tilings(documents([]), benchmark).count() == 0
    assert contamination.tilings(documents(rows), benchmark.where("false")).count() == 0


# --- toxicity


@pytest.fixture
def labelled(spark, documents, prose, rng):
    rows, labels = [], []
    for k in range(500):
        words = prose(rng.randrange(20, 60)).split()
        bad = rng.random() < 0.3
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grobfug", "grobfuge", "idiot", "you"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "ÄÖÜ!!! $$$ 1d1ot"), (None, "nothing")]
    return documents(rows), spark.createDataFrame(labels + [(1000, 1, None), (3, 1, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    table, labels = labelled
    model = toxicity.learn(table, labels, trees=5)
    scored = model.score(table)
    assert scored.columns == [c for c in table.columns if c != "score"] + ["score", "predicted"]
    got = {r.doc_id: (r.score, r.predicted) for r in scored.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and r.doc_id is not None}
    out = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k][1] == truth[k] for k in out) / len(out) > 0.9
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values()) and len(got) == 504
    kept = model.accepted(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, (s, _) in got.items() if s < 0.5}


def test_texts_of_one_opening_all_teach(spark, documents, prose):
    banner = "one banner that begins each text of this source"
    rows = [(k, f"{banner} {prose(9)}") for k in range(40)] + [(50, f"{banner} same"), (51, f"{banner} same"), (52, f"{banner} same not")]
    labels = [(k, int(k % 3 == 0)) for k in range(40)] + [(50, 0), (51, 1), (52, 0)]
    kept = [(text, toxic) for (k, text), (_, toxic) in zip(rows, labels) if zlib.crc32(str(k).encode()) % 5]
    want = {}
    for text, toxic in kept:
        want[text] = max(toxic, want.get(text, 0))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.training_rows(documents(rows), labels, 20_000).collect()
    assert sorted((r.text, r.toxic) for r in got) == sorted(want.items())


def test_toxicity_without_two_classes(labelled, documents):
    table, labels = labelled
    model = toxicity.learn(table, labels.where("toxic = 0"))
    assert {(r.score, r.predicted) for r in model.score(table).collect()} == {(0.0, 0)}
    model = toxicity.learn(table, labels.where("false"))
    assert model.score(documents([])).count() == 0


# --- the pipeline


def test_pipeline(spark, tmp_path, documents, prose, labelled):
    table, labels = labelled
    item, shared, copied = prose(40), prose(70), prose(200)
    rows = [
        (2001, copied), (2002, copied + " end"), (2003, f"{prose(150)} {shared} {prose(150)}"),
        (2004, f"{prose(150)} {shared} {prose(150)}"), (2005, f"{prose(60)} {item} {prose(60)}"),
        (2006, prose(120)),
    ]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = table.select(columns).union(documents(rows).select(columns))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in labels.collect() if r.toxic == 1}
    assert len(bad & left["toxicity"].keys()) < 0.1 * len(bad) and 2006 in left["toxicity"]
    assert 2001 in left["near_copies"] and 2002 not in left["near_copies"]
    assert shared in left["repeats"][2003] and shared not in left["repeats"][2004]
    assert left["repeats"][2006] == rows[5][1]
    assert 2005 not in left["decontamination"] and 2006 in left["decontamination"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    check_packed(list(left["decontamination"].items()), pieces)


def test_ids_of_odd_words_are_those_of_the_named_call(rng):
    """Special strings, their look-alikes, marks and letters that change with case."""
    tokenizer = Tokenizer.from_file(packing.WORD_BPE)
    texts = ["<|endoftext|> hi", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "a|b | c || |", "it's, x. İstanbul ŉ", "", " "]
    letters = ["ab|c .,", " theandiron'st", "1 2,3.x", "éèÀÜ çßÅ", "!?;:.,a ", "\t\nab\x1c\x85", "ǅǆĲ ŉ'n", "<|endoftx> "]
    texts += ["".join(rng.choices(a, k=rng.randrange(60))) for a in letters for _ in range(300)]
    want = [packing.packed_ids(found.ids) for found in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = packing.WordIds(packing.WORD_BPE)
    # The second time, and in another order of marks, all parts are known.
    assert encoder.encode(texts) == want and encoder.encode(texts) == want
    assert encoder.encode(["a.b", "b.a"]) == [packing.packed_ids(tokenizer.encode(t).ids) for t in ("a.b", "b.a")]


CLASHING = (
    "_doc _hash _spans _text _other _other_hash _id hash row spans of left leak text_hash start end kind bits key"
    " component_id cluster_id kept_doc_id kept_start first last places bands n doc score predicted copies"
).split()


def test_extra_columns_of_any_name_stay(spark, tmp_path, prose):
    """All working names as columns of the documents: they come out of every stage."""
    shared = prose(60)
    rows = [(1, f"{prose(40)} {shared}"), (2, f"{shared} {prose(50)}"), (3, prose(30)), (4, None), (5, "")]
    rows.append((6, rows[0][1]))
    columns = [F.lit(f"own {name}").alias(name) for name in CLASHING]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *columns)

    def whole(found):
        assert found.columns == table.columns
        for r in found.collect():
            assert [r[name] for name in CLASHING] == [f"own {name}" for name in CLASHING]
        return {r.doc_id: r.text for r in found.collect()}

    assert whole(simhash.one_of_each(table)).keys() == {1, 2, 3, 4}
    places = passages.repeats(table)
    cut = whole(passages.cut_out(table, places))
    assert cut[1] == rows[0][1] and shared not in cut[2] and 6 not in cut
    spark.createDataFrame([(1, rows[2][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert whole(corpus_pipeline.without_leaks(spark, table, str(tmp_path))).keys() == {1, 2, 4, 5, 6}
    assert packing.pack(table).count() > 0
    assert {r.doc_id for r in contamination.tilings(table, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()} == {3}


def test_only_one_machine_may_go_without_a_shared_folder():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, applicationId=f"app of {master}")
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)

    assert shared_folder(session("local[4]", "s3a://bucket/shared/"), "t").startswith("s3a://bucket/shared/t-")
    first, second = (shared_folder(session("local[4]"), "t") for _ in range(2))
    assert first != second and first.rpartition("/")[0] == second.rpartition("/")[0]
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master), "t")
