"""Held-out accuracy of what is learned, and the scoring formulas."""

import random
import zlib

import numpy as np
import pytest

from blockloom.llm import langid, toxicity

from conftest_llm import SCHEMA, prose

SYLLABLES = {"en": "th er ing ou and tion ed", "fr": "eau oi que ré ment le eux", "de": "sch ung ein keit ach pf ü"}


def made(lang, rng, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_by_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(k, made(lang := ("en", "fr", "de")[k % 3], rng, 30), lang if k % 7 else None, None, None) for k in range(600)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {k: ("en", "fr", "de")[k % 3] for k in range(600)}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_gram_vectors_bind_rotated_letters():
    v = langid.symbol_vectors().astype(int)
    codes = np.array([(97 << 16) | (98 << 8) | 99])
    want = np.roll(v[97], 2) * np.roll(v[98], 1) * v[99]
    assert np.array_equal(langid.Grams.bind(codes)[0], want)
    kept = langid.Grams()
    assert np.array_equal(kept.of(codes)[0], want) and np.array_equal(kept.of(codes)[0], want)
    assert langid.bundle("1 2 !") is None and langid.bundle("") is None and abs(np.linalg.norm(langid.bundle("abc")) - 1) < 1e-5


def test_letters_beyond_latin_have_vectors_of_their_own():
    letters = np.array([ord(c) for c in "αβγабвאבجд日本語ａ中"] + [0x100 + 96 * k for k in range(20)], np.int64)
    v = langid.vectors_of(letters).astype(int)
    assert set(v.ravel().tolist()) == {-1, 1}
    cosines = v @ v.T / langid.DIMENSIONS
    assert np.abs(cosines - np.eye(len(letters))).max() < 0.2
    bundle = {t: langid.bundle(t) for t in ("αβγδ εζηθ", "абвг дежз", "日本語の文章", "Αβγδ Εζηθ")}
    assert abs(bundle["αβγδ εζηθ"] @ bundle["Αβγδ Εζηθ"] - 1) < 1e-5
    assert abs(bundle["αβγδ εζηθ"] @ bundle["абвг дежз"]) < 0.3


def test_language_ties_go_by_code_point():
    same = langid.bundle("some words").astype(float)
    assert langid.Profiles({"b": same, "a": same}).predict("some words")[0] == "a"


def documents(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 8 == 0
        w = prose(seed * 10_000 + k, rng.randrange(30, 120)).split()
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(["vrekk", "zwolm"]) + rng.choice(["ed", "ing", "oso", f"ya{k % 50}", "ul"])
        rows.append((k, " ".join(w), None, None, None))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_by_held_out_rows(spark):
    rows, labels = documents(1, 1500)
    out = toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(r["predicted"], labels[r["doc_id"]][2], r["score"]) for r in out if r["held_out"]]
    assert len(held) > 200
    assert np.mean([p for p, y, _ in held if y]) > 0.9 and np.mean([p for p, y, _ in held if not y]) < 0.02
    assert all(0 <= s <= 1 and p == (s >= 0.5) for p, _, s in held)


def test_held_out_labels_are_not_used(spark):
    rows, labels = documents(2, 300)
    swapped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in (labels, swapped))
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b])


def test_grams_stay_in_their_word():
    s, starts = toxicity.symbols(["ab  c", "d"])
    keys = toxicity.gram_keys(s, starts).tolist()
    o = ord
    assert s.tolist() == [0, o("a"), o("b"), 0, o("c"), 0, 0, o("d"), 0] and starts.tolist() == [0, 6, 9]
    assert keys == [0, o("a"), o("a") << 8 | o("b"), (o("a") << 8 | o("b")) << 8, o("c"), o("c") << 8, 0, o("d"), o("d") << 8]


class PlainModel:
    """The docstring's formula on strings, for any symbol after any history, with every recursion spelled out."""

    def __init__(self, rows):
        self.counts = [{}, {}]
        for text, label in rows:
            for word in self.words(text):
                for k in range(1, len(word)):
                    gram = word[max(0, k - 6) : k + 1].rjust(7, "_")
                    self.counts[label][gram] = self.counts[label].get(gram, 0) + 1
        both = {g: self.counts[0].get(g, 0) + self.counts[1].get(g, 0) for g in {*self.counts[0], *self.counts[1]}}
        self.tables = {7: both}
        for order in range(6, 0, -1):
            self.tables[order] = {}
            for g in self.tables[order + 1]:
                self.tables[order][g[1:]] = self.tables[order].get(g[1:], 0) + 1

    @staticmethod
    def words(text):
        return ["_" + w + "_" for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]

    def shared(self, gram):
        table, h = self.tables[len(gram)], gram[:-1]
        if len(gram) == 1:
            return (max(table.get(gram, 0) - 0.75, 0) + 0.75 * len(table) / 256) / sum(table.values())
        own = [n for g, n in table.items() if g[:-1] == h]
        if not own:
            return self.shared(gram[1:])
        return (max(table.get(gram, 0) - 0.75, 0) + 0.75 * len(own) * self.shared(gram[1:])) / sum(own)

    def p(self, c, gram, s=toxicity.SHARED_WEIGHT):
        own = {g: n for g, n in self.tables[7].items() if g[:-1] == gram[:-1]}
        if not own:
            return self.shared(gram[1:])
        total, back = sum(own.values()), 0.75 * len(own) / sum(own.values())
        pooled = max(own.get(gram, 0) - 0.75, 0) / (total - 0.75 * len(own))
        q = (self.counts[c].get(gram, 0) + s * pooled) / (sum(self.counts[c].get(g, 0) for g in own) + s)
        return (1 - back) * q + back * self.shared(gram[1:])

    def difference(self, text):
        words = self.words(text)
        total = 0.0
        for word in words:
            grams = [word[max(0, k - 6) : k + 1].rjust(7, "_") for k in range(1, len(word))]
            d = sum(np.log(self.p(1, g)) for g in grams) - sum(np.log(self.p(0, g)) for g in grams)
            total += np.log(1 - toxicity.EXPRESSIONS + toxicity.EXPRESSIONS * np.exp(d))
        return total / max(1, len(words)) ** 0.5


LABELLED = [("abc abd abe abc xyz the theory of everything", 0), ("abd abd abq these", 1), ("thesis antithesis, ABC!", 0), ("xyz xyq abqab", 1), ("abq", 1)]
SCORED = ["abc", "abq abd", "the theories of abqab", "unknown wörter xyzabc", "x", "", "42", "Antithesis thesauri and everything else, abe", "a"]


def test_scores_are_those_of_a_plain_model(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in LABELLED]), pa.array([y for _, y in LABELLED], pa.int32()), pa.array([0, 1, 0, 0, 1], pa.int32())], ["text", "label", "sampled"])
    rows = [r for b in toxicity.count_grams([batch]) for r in b.to_pylist()]
    counts = [(r["gram"], *(sum((r[c] >> shift) & 0xFFFFFFFF for c in ("rest", "sample")) for shift in (0, 32))) for r in rows]
    grams = spark.createDataFrame(counts, "gram long, ordinary long, toxic long")
    table = toxicity.score_table(toxicity.log_ratios(grams, toxicity.backoff(grams)))
    plain = PlainModel(LABELLED)
    assert sorted(map(sum, (plain.counts[0].values(), plain.counts[1].values()))) == sorted((sum(c[1] for c in counts), sum(c[2] for c in counts)))
    got, n = toxicity.judged(SCORED, table)
    assert got == pytest.approx([plain.difference(t) for t in SCORED], abs=1e-5)
    assert n.tolist() == [len(plain.words(t)) for t in SCORED]


def test_the_plain_model_is_a_distribution():
    plain = PlainModel(LABELLED)
    letters = [chr(k) for k in range(256 + 0x4E00 - 1, 0x4E00 - 1, -1)]  # 256 symbols, whichever they are
    known = {g[-1] for g in plain.tables[1]}
    alphabet = [*known, *letters[: 256 - len(known)]]
    for history in ("____ab", "__the_"[:6], "______", "qqqqqq"):
        for c in (0, 1):
            assert sum(plain.p(c, history + w) for w in alphabet) == pytest.approx(1)


def test_a_table_of_one_short_text(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)
    got = toxicity.toxicity(docs, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 1 and 0 <= got[0]["score"] <= 1
    for text in ("", "a", "ab", "é"):
        assert len(toxicity.gram_keys(*toxicity.symbols([text]))) == len(toxicity.symbols([text])[0])


def test_unseen_grams_have_no_ratio():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 1 << 56, 300_000, dtype=np.int64))
    seen, unseen = keys[::2], keys[1::2]
    table = toxicity.Ratios(seen, np.arange(1, len(seen) + 1, dtype=np.float32))
    assert (table.of(seen.view(np.uint64)) == np.arange(1, len(seen) + 1)).all()
    assert not table.of(unseen.view(np.uint64)).any()
    assert not toxicity.Ratios(seen[:0], np.zeros(0, np.float32)).of(unseen.view(np.uint64)).any()


def test_shuffled_ratios_give_the_same_scores(spark, monkeypatch, odd):
    rows, known = documents(1, 300)
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd)
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    scored = lambda: sorted(str((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"])) for r in toxicity.toxicity(docs, labels).collect())
    near, kept = scored(), sorted(map(str, toxicity.toxic_out(docs, labels).collect()))
    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", 0)
    assert scored() == near
    assert sorted(map(str, toxicity.toxic_out(docs, labels).collect())) == kept
