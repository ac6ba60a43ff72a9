import itertools
import random
import zlib

import numpy as np
import pytest

from cartolith.llm import toxicity as tx


@pytest.fixture(scope="module")
def model():
    words = "the and this that with from stone river garden forest little under people house idiot moron stupid bee book attic".split()
    counts = np.zeros(tx.SIZE**3)
    return tx.trigram_model(tx.with_words(counts + 1e-6, dict.fromkeys(words, 1.0)))


@pytest.mark.parametrize(("raw", "want"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("s t u p i d", "stupid"), ("m.o.r.o.n", "moron"), ("i d i 0 t", "idiot"), ("book", "book"), ("attic", "attic"), ("$tup!d", "stupid"), ("mmoorroonn", "moron"), ("", "")])
def test_decoding(model, raw, want):
    assert tx.decode(raw, model) == want


def brute_decode(raw, model):
    """All paths of the lattice, one by one."""
    options = []
    for i, c in enumerate(raw):
        s = tx.symbol(c)
        again = i and raw[i - 1] == c
        if s:
            options.append([(tx.DROPPED_REPEAT, ""), (tx.KEPT_REPEAT, c)] if again else [(0.0, c)])
        else:
            o = [(tx.LOOKALIKE, x) for x in tx.LOOKS.get(c, "")] + ([(tx.DROPPED_REPEAT, "")] if again and c in tx.LOOKS else [])
            options.append([*o, (tx.JOINED if c in " .-_" else tx.DROPPED_SIGN, ""), (tx.BORDER, " ")])
    best = (-np.inf, None)
    for path in itertools.product(*options):
        score, a, b, text = 0.0, 0, 0, ""
        for cost, x in path:
            score += cost
            s = 0 if x == " " else tx.symbol(x) if x else None
            if s is None or (s == 0 and b == 0):
                continue
            score += float(model[a, b, s])
            a, b, text = b, s, text + x
        score += float(model[a, b, 0]) if b else 0
        if score > best[0] + 1e-9:
            best = (score, text.strip())
    return best[1]


def test_viterbi_is_the_best_of_all_paths(model):
    rnd = random.Random(1)
    for _ in range(60):
        raw = "".join(rnd.choice("idot 10m.rn$") for _ in range(rnd.randint(1, 7)))
        assert tx.decode(raw, model) == brute_decode(raw, model), raw


def test_held_out_and_disguised(spark):
    rnd = random.Random(5)
    syl = ["the", "ri", "ver", "on", "ing", "ston", "gar", "den", "for", "est", "un", "der", "lit", "tle", "an"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    bad = ["idiot", "moron", "stupid", "loser"]
    hide = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0"), " ".join, lambda w: w[:2] + w[1] * 3 + w[2:], ".".join, str.upper]
    rows, lab = [], []
    for i in range(900):
        t = [word() for _ in range(rnd.randint(5, 60))]
        if toxic := i % 5 == 0:
            for _ in range(2):
                t.insert(rnd.randrange(len(t)), rnd.choice(bad))
        rows.append((i, " ".join(t)))
        lab.append((i, 1, int(toxic)))
    disguised = [(2000 + i, " ".join([word() for _ in range(20)] + [h(w)] + [word() for _ in range(10)])) for i, (h, w) in enumerate(itertools.product(hide, bad))]
    clean = [(3000 + i, " ".join(word() for _ in range(60))) for i in range(60)] + [(3100, "call 555 0100 at a b 3.14 or x-ray, e.g. 10th; see v2.0 & A B C"), (3101, "1 2 3 4 5 6 7 8 9")]
    edge = [(4000, None), (4001, ""), (None, "idiot"), (5, rows[5][1])]
    df = spark.createDataFrame(rows + disguised + clean + edge, "doc_id long, text string").selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame(lab + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = tx.toxicity(df, labels).collect()
    assert len(got) == len(rows + disguised + clean + edge)
    by = {r.doc_id: r for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out for i in held)
    assert np.mean([by[i].predicted == (i % 5 == 0) for i in held]) > 0.98
    assert np.mean([by[i].predicted for i, _ in disguised]) > 0.9
    assert not any(by[i].predicted for i, _ in clean)
    assert by[4000].score == by[4001].score and by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert tx.toxicity(df.limit(0), labels).count() == 0
    assert {r.score for r in tx.toxicity(df, labels.limit(0)).collect()} == {0.0}
    restored = {r.doc_id: r.restored for r in tx.restored_texts(df, labels).collect()}
    assert all(w in restored[2000 + i].split() for i, (_, w) in enumerate(itertools.product(hide[:3], bad)))


@pytest.mark.parametrize(("chunk", "want"), [("$tupid", "stupid"), ("!diot", "idiot"), ("$tup1d", "stupid"), ("!d10t", "idiot"), ("-$tupid,", "stupid"), ("(1d10t!", "idiot"), ("mor*n", "moron"), ("b**", "bee")])
def test_signs_at_the_edge_are_read(model, chunk, want):
    assert want in tx.Restorer(model).words(chunk)


def test_plain_edges_stay(model):
    r = tx.Restorer(model)
    assert r.words("house!")[0] == "house" and r.words("(river)")[0] == "river" and r.words("2024") == r.words("!!!") == r.words("3.14") == []


def learnt(spark, others):
    """predicted of further texts, after learning from plain ones."""
    rnd = random.Random(8)
    syl = ["the", "ri", "ver", "on", "ing", "ston", "gar", "den", "for", "est", "un", "der", "lit", "tle", "an"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    rows = [(i, " ".join([word() for _ in range(rnd.randint(5, 40))] + ["idiot", "stupid"] * (i % 5 == 0))) for i in range(500)]
    more = [(1000 + i, f"{word()} {word()} {t} {word()}") for i, t in enumerate(others)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in tx.toxicity(spark.createDataFrame(rows + more, "doc_id long, text string"), labels).collect()}
    return [got[i] for i, _ in more]


def test_sign_led_disguises_are_toxic(spark):
    assert learnt(spark, ["$tupid", "!diot", "$tup1d", "!d10t", "(river", "garden!", "$100"]) == [1, 1, 1, 1, 0, 0, 0]


def test_long_chunks_are_read(model):
    r = tx.Restorer(model)
    assert "stupid" in r.words("stu" + "u" * 70 + "pid")
    for sep in "-/—_":
        assert "idiot" in r.words(sep.join(["river", "garden", "forest"] * 5 + ["1d10t"] + ["house", "people"] * 5))
    assert len(r.words("stone/" * 20_000)) >= 20_000


def test_white_space_of_unicode(model):
    for space in ("\u00a0", "\u3000", "\u2003"):
        text = space.join(["river", "garden"] * 20 + ["1d10t", "m", "0", "r", "o", "n"] + ["house"] * 20)
        parts = tx.documents_words([text.encode()], tx.Restorer(model), {})
        words = next(parts)
        own, extra = next(parts)
        assert "idiot" in [w for i in own.tolist() for w in words[i]] and "moron" in extra


def test_disguises_in_long_chunks_are_toxic(spark):
    around = ["river", "garden", "forest", "under"] * 6
    assert learnt(spark, ["stu" + "u" * 70 + "pid", "/".join([*around, "1d10t", *around]), "\u00a0".join([*around, "1d10t", *around]), "/".join(around)]) == [1, 1, 1, 0]


def test_only_copies_are_counted_once(spark, model):
    """Texts that share nearly all words are not copies; the same words in another order are."""
    least = "river garden forest stone house people under little"
    texts = [f"{least} moron {x}" for x in "abcdefghijklmnopqrst"]
    rows = list(enumerate([*texts, *texts, *(" ".join(reversed(t.split())) for t in texts)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sampled = spark.createDataFrame([(i, int(i % 20 < 12)) for i, _ in rows], "doc_id long, label int")
    got = {r.feature: (r.toxic, r.other) for r in tx.feature_counts(docs, sampled, spark.sparkContext.broadcast(model)).collect()}
    assert got["^moron$"] == (12, 8)


def test_runs_with_lone_separators_and_of_any_length():
    codes = lambda t: ({c: i for i, c in enumerate(dict.fromkeys(t.split()))}, t.split())
    place, chunks = codes("so s - t - u now - - a - b")
    single = np.array([len(c) == 1 and c.isalnum() for c in place])
    between = np.array([c.encode() in tx.SEPARATORS for c in place])
    assert tx.spaced_runs(np.array([place[c] for c in chunks]), single, between) == [(1, 6)]


def test_stems_that_several_words_share():
    chunks = [["grobian"], ["grobiane", "grobian"], ["x"], ["grobheit"]]
    assert tx.shared(["grobian", "grobiane", "grobheit"]) == ["^grobi+", "^grobia+", "^grobian+"]
    assert tx.document_features(chunks) >= {"^grobi+", "^x$", "^grobheit$"} and "^grobian$" not in tx.document_features(chunks)
    lexicon = tx.Lexicon([("^grobian+", 9, 0), ("^lose", 30, 3)], 0.1, 0.0, frozenset({"^loses"}))
    assert lexicon.left([["grobian"], ["grobian"]]) == 1 and lexicon.left([["grobian"], ["grobianen"]]) < 0.2
    assert lexicon.of("losing") == 0 and lexicon.of("loser") > 0.8 and lexicon.of("loseste") == 0


def test_prior_has_one_rule_for_any_number_of_features():
    rows = [(f"^{w}$", 9, 0) for w in ("abcde", "abcdef")] + [(f"^{w}", 9, 0) for w in ("abcd", "abcde", "wxyz")]
    rows += [(f"^q{i:06d}", 9, 0) for i in range(6000)]
    prior = tx.Lexicon(rows, 0.1, 0.0).prior()
    assert {"abcde", "abcdef", "wxyz"} <= set(prior) and "abcd" not in prior and len(prior) == 6003


def test_whole_query_like_a_plain_reading(spark):
    """Scores by the definition, word after word, from the model that was learned."""
    rnd = random.Random(8)
    plain = [a + b for a in ("ber", "gol", "tin", "mar", "sul") for b in ("do", "ra", "nik", "pel", "us")]
    rows, labels = [], []
    for i in range(400):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 40))]
        bad = i % 7 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["grumshit", "gr1mshit", "g r u m s h i t", "grummmshit,", "grumshiter", "grumshite"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "berdo " * 3000 + "stone/" * 3000 + "grumsh1t/river"), (1003, "g - r - u - m - s - h - i - t"), (None, "grumshit")]
    docs, label = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(docs, label).collect()}
    lexicon, model = tx.learn(docs, label, 8000, 30.0)
    restorer = tx.Restorer(model, {f.strip("^$+") for f in lexicon.p})
    for i, t in rows:
        parts = tx.documents_words([(t or "").encode()], restorer, {})
        words = next(parts)
        own, extra = next(parts)
        chunks = [words[k] for k in sorted(set(own.tolist()))] + [(w,) for w in sorted(set(extra))]
        left = 1 - lexicon.rest
        family = {}
        for ws in chunks:
            first = {}
            for w in ws:
                family.setdefault(w[:5], {}).setdefault(first.setdefault(w[:5], w), set()).add(w)
        for members in family.values():
            p = max(lexicon.of(w) for ws in members.values() for w in ws)
            if len(members) > 1:
                p = max([p, *(lexicon.p.get(f"^{s}+", 0.0) for n in (5, 6, 7) for s in {w[:n] for w in members if len(w) >= n} if sum(len(w) >= n and w[:n] == s for w in members) > 1)])
            left *= 1 - p
        assert got[i].score == pytest.approx(1 - left) and got[i].predicted == (got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2)
    assert got[1002].predicted and got[None].predicted and not got[1000].predicted
    right = [got[i].predicted == y for i, y in labels]
    assert sum(right) >= 0.97 * len(right)
