"""The dealt operators against brute force, exact round trips and held-out cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import abuse, canon, language, mixing, neardup, overlap, pairdefects, splits, tokenise, words
from millrace.session import table

DIR = "/root/testdata/sf0.001"


def near(a, b):
    x, y = set(words.py_words(a)), set(words.py_words(b))
    return bool(x & y) and 5 * len(x & y) >= 4 * len(x | y)


# p1
@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ｆｕｌｌ width", "full width", True), ("été", "été", True), ("a b", "a b", True), ("in​visi­ble", "invisible", True), ("pаypаl", "paypal", True), ("ﬁsh…", "fish...", True),
        ("Привет, как дела", "Пpивeт, кaк дeлa", True), ("Case", "case", False), ("cafe", "café", False), ("a, b", "a b", False), ("a  b", "a b", False), ("x²", "x2", False), ("👩‍💻", "👩💻", False),
        ("vд", "νд", True), ("Nд", "Νд", True), ("Yк", "Υк", True), ("ɑbc", "abc", True), ("ɡood", "good", True), ("ρ", "p", True), ("υ", "u", True), ("Ꭺ", "A", True), ("հ", "h", True), ("ꓮΒС", "ABC", True),
        ("e\u200b\u0301", "é", True), ("e\u0323\u0302", "ệ", True), ("e\u0302\u0323", "ệ", True), ("ê\u0323", "ệ", True), ("\u1112\u1161\u11ab", "한", True), ("=\u0338", "≠", True), ("a\u0316\u0301", "á\u0316", True),
        ("a\u0301\u0300", "a\u0300\u0301", False), ("д", "d", False), ("б", "6", False),
    ],
)
def test_looks(a, b, same):
    assert (canon.canonical(a) == canon.canonical(b)) is same


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoоеаοcсpрВBНH ​ ́éﬁ中,.👩💻‍ｆяж"), max_size=30))
def test_canonical_is_idempotent(text):
    once = canon.canonical(text)
    assert canon.canonical(once) == once


def test_conflicts_are_found():
    with pytest.raises(ValueError, match="conflict"):
        canon.check_mapping({"x": "y", "y": "z"}, {})
    with pytest.raises(ValueError, match="conflict"):
        canon.check_mapping({"а": "б"}, {"а": 0})
    with pytest.raises(ValueError, match="conflict"):
        canon.check_mapping({"abc": "x", "ab": "y", "yc": "z"}, {})
    with pytest.raises(ValueError, match="two classes"):
        canon.build_looks(["ab", "bc"])


def test_every_character_has_one_form_however_it_is_made_up():
    import unicodedata

    for code in range(0x80, 0x30000):
        char = chr(code)
        if unicodedata.category(char) not in ("Cn", "Cs", "Co"):
            form = canon.canonical(char)
            assert canon.canonical(form) == form == canon.canonical(unicodedata.normalize("NFD", char)), hex(code)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(canon.ALIKE + [c for c in "дfжωzb"]), min_size=1, max_size=6), st.randoms())
def test_words_that_look_the_same_are_equal(classes, rng):
    a, b = ("".join(rng.choice(c) for c in classes) for _ in range(2))
    assert canon.canonical(a) == canon.canonical(b)


def test_look_alike_pairs(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "!"), (5, "！"), (6, None), (7, "A b"), (2, "a b")]
    got = {tuple(r) for r in canon.look_alike_pairs(spark.createDataFrame(rows, "line_no long, text string")).collect()}
    assert got == {(1, 2), (2, 3)}


# p2
def variants(rng, base, count):
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(["perhaps", "always", "today", "w%d" % rng.randint(0, 99)])
        if rng.random() < 0.3:
            rng.shuffle(w)
        out.append(" ".join(w))
    return out


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for b in range(12):
        base = " ".join(f"t{b}x{i}" if i % 3 else f"common{i}" for i in range(30))
        texts += variants(rng, base, 8)
    texts += ["", "...", texts[0], texts[0].upper()]
    rows = [("experience", f"id{i:03d}", t) for i, t in enumerate(texts)]
    want = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if near(a[2], b[2])}
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(spark.createDataFrame(rows, "field string, id string, text string")).collect()}
    assert got == want and len(want) > 100
    groups = neardup.near_groups(spark.createDataFrame(rows, "field string, id string, text string"))
    by = {r.id: r.group_id for r in groups.collect()}
    assert all(by[a] == by[b] for a, b in want)


def test_bands():
    n = neardup.bands_for(6, 0.9999)
    assert 1 - (1 - 0.8**6) ** n >= 0.9999 > 1 - (1 - 0.8**6) ** (n - 1)


# p3
def test_families_and_splits_grow(spark):
    schema = "sample_id string, source_sample_id string"
    first = spark.createDataFrame([(f"s{i}::item-{j:02d}", f"S{i} " if j else None) for i in range(60) for j in range(2)], schema)
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    state = splits.SplitTable(spark)
    one = {r.sample_id: (r.component, r.split) for r in state.update(first, shares).collect()}
    assert all(one[f"s{i}::item-00"] == one[f"s{i}::item-01"] for i in range(60))
    share = sum(s == "train" for _, s in one.values()) / len(one)
    assert abs(share - 0.8) < 0.06
    by_split = {s: next(i for i, (_, x) in one.items() if x == s).split("::")[0] for s in ("train", "test")}
    more = first.unionByName(spark.createDataFrame([("new::item-00", "s1"), ("bridge::item-00", by_split["train"]), ("bridge::item-00", by_split["test"])], schema))
    two = {r.sample_id: r for r in state.update(more, shares).collect()}
    assert two["new::item-00"].split == one["s1::item-00"][1]
    assert two["bridge::item-00"].quarantined and two[f"{by_split['train']}::item-00"].quarantined
    untouched = [i for i in one if i.split("::")[0] not in by_split.values()]
    assert all(two[i].split == one[i][1] for i in untouched)


def test_split_table_forgets_nothing(spark):
    """Links and quarantines survive runs and reopening: given names, merged roots, old splits."""
    shares = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, share double")

    def run(table, *rows):
        return {r.sample_id: r for r in table.update(spark.createDataFrame(list(rows), "sample_id string, source_sample_id string"), shares).collect()}

    table = splits.SplitTable(spark)
    first = run(table, ("a::item-0", "c"), ("m::item-0", "n"))
    assert {first["a::item-0"].split, first["m::item-0"].split} == {"train", "test"}
    again = splits.SplitTable(spark, table.home)
    assert again.version == table.version
    # a name that only source_sample_id told, together with one of another split
    second = run(again, ("n::item-5", "c"))["n::item-5"]
    assert second.quarantined and second.split is None and second.component == "a"
    # both old families are now one, in any later run
    third = run(splits.SplitTable(spark, table.home), ("m::item-7", None), ("a::item-3", None), ("q::item-0", None))
    assert third["m::item-7"].quarantined and third["a::item-3"].quarantined and third["m::item-7"].component == "a"
    assert not third["q::item-0"].quarantined and third["q::item-0"].split
    last = splits.SplitTable(spark, table.home)
    last.resolve(spark.createDataFrame([("a", "test")], "component string, split string"))
    fourth = run(last, ("m::item-8", "0early"), ("c::item-1", None))
    assert all(r.split == "test" and r.component == "0early" for r in fourth.values())
    assert {r.sample_id: r.component for r in last.items().collect()} == dict.fromkeys(("a::item-0", "m::item-0", "n::item-5", "m::item-7", "a::item-3", "m::item-8", "c::item-1"), "0early") | {"q::item-0": "q"}
    assert {r.component: r.ids for r in last.states().collect()} == {"0early": 7, "q": 1}


def test_family_rows(spark):
    rows = [("a::item-00", "B"), ("b::item-00", None), ("c::item-00", " b "), ("d::item-00", "d"), ("d::item-00", "d"), (None, "a"), ("e::item-01", "")]
    got = {tuple(r) for r in splits.family_rows(spark.createDataFrame(rows, "sample_id string, source_sample_id string")).collect()}
    assert got == {("a::item-00", "b::item-00"), ("a::item-00", "c::item-00")}


# p4
def test_overlaps_equal_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(f"b{k}w{i}" for i in range(25)) for k in range(8)]
    rows = [(n, rng.choice(["train", "test", "validation"]), f"id{rng.randint(0, 30)}" if n % 5 == 0 else None, f"x/m_{rng.randint(0, 30)}.jpg" if n % 4 == 0 else " ", rng.choice(variants(rng, rng.choice(base), 1))) for n in range(120)]
    rows.append((500, "other", "id1", None, base[0]))
    frame = spark.createDataFrame([(n, s, None, i, p, t) for n, s, i, p, t in rows], "line_no long, split string, source string, sample_id string, image_path string, text string")
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            across = "other" not in (a[1], b[1]) and (a[1] == "train") != (b[1] == "train")
            same_id, same_file = a[2] and a[2] == b[2], a[3] and b[3] and a[3].strip() and a[3] == b[3]
            if across and (same_id or same_file or near(a[4], b[4])):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert {tuple(r) for r in overlap.overlaps(frame).collect()} == want and len(want) > 100


def test_winnowing_loses_no_near_same_pair():
    """Any two sets of a similarity of 0.8 or more share a fingerprint, whichever words differ and however common each is."""
    import pandas as pd

    rng, rows = random.Random(11), []
    for _ in range(4000):
        size = rng.randint(4, 60)
        pool = rng.sample(range(1, 1 << 40), size + size // 4)
        both, extra = pool[:size], pool[size:][: rng.randint(1, size // 4)]
        own = rng.randint(0, len(extra))
        for words_ in ([*both, *extra[:own]], [*both, *extra[own:]]):
            rng.shuffle(words_)
            rows.append(np.array(words_))
    counts = np.array([rng.randint(1, 3) for _ in range(overlap.COUNT_BUCKETS)])
    frame = pd.DataFrame({"cls": [b"x"] * len(rows), "in_train": True, "all_train": True, "hashes": rows})
    prints = next(overlap._fingerprints(iter([frame]), counts))["prints"]
    assert all(set(prints[k]) & set(prints[k + 1]) for k in range(0, len(rows), 2))


def test_report_counts_by_class(spark):
    rows = [(1, "train", "s", "i1", "a/x.jpg", "one two three four five six"), (2, "test", "s", "I1 ", None, "other"), (3, "test", "s", None, "b/X.JPG", "else"), (4, "test", "s", None, None, "six one two three four five"), (5, "test", "s", None, None, "one two three four five six seven"), (6, "validation", None, None, None, None)]
    frame = spark.createDataFrame(rows, "line_no long, split string, source string, sample_id string, image_path string, text string")
    got = {r.split: r for r in overlap.overlap_report(frame).collect()}
    t = got["test"]
    assert (t.records, t.by_id, t.by_image, t.by_text, t.overlapping) == (4, 1, 1, 2, 4) and abs(t.mean_coverage - (1 + 5 / 7) / 4) < 1e-9  # 'six' is not in its place
    assert got["validation"].overlapping == 0 and {tuple(r) for r in overlap.overlaps(frame).collect()} == {(1, 2), (1, 3), (1, 4), (1, 5)}


def test_file_names(spark):
    paths = ["a/b/m_1-2.jpg", "a\\b\\M_1-2.JPG", "/x/m%5F1%2D2.jpg?v=3", "./a/../a/m_1-2.jpg", " ", None, "m_1-2.png"]
    got = [r.f for r in spark.createDataFrame([(p,) for p in paths], "p string").select(overlap.file_name("p").alias("f")).collect()]
    assert got == ["m_1-2.jpg"] * 4 + [None, None, "m_1-2.png"]


def test_alignment():
    a, b = "one two three four five six".split(), "zero one two three x four five six".split()
    assert overlap.aligned(a, b) == 6 and overlap.aligned(a, ["none"]) == 0
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in overlap.chain(a, b))


# p5
def test_language_held_out(spark):
    rows = table(spark, "/root/testdata/sf0.01", "samples")
    texts, codes = language.sample_labelled(rows, "line_no", "text", language.label_language(F.col("language")))
    half = len(texts) // 2
    model = language.fit(texts[:half], codes[:half])
    right = 0
    for text, code in zip(texts[half:], codes[half:], strict=True):
        w = [t for t, _ in language.tokens(text)]
        right += not w or language.LANGUAGES[int(model.segment(w).argmax())] == code
    assert right / (len(texts) - half) > 0.85  # labels are wrong now and then
    mixed = "my printer is broken again, thank you for the service. Wer hat eigentlich den Drucker vor dem Kaffee repariert?"
    cut = language.tokens(mixed)
    found = language.segments(model, [cut, [], cut[:3]], np.concatenate([model.words([t for t, _ in c]) for c in (cut, cut[:3])]))
    assert [s[0] for s in found[0] if s[3]] == ["en", "de"] and found[1] == [] and len(found[2]) == 1


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    sizes = np.array([4, 1, 6, 3])
    scores, fresh = rng.normal(size=(14, 3)), rng.random(14) < 0.3
    path, at = language.viterbi(scores, fresh, sizes), 0
    for n in sizes:
        worth = lambda p: sum(scores[at + k, q] for k, q in enumerate(p)) - sum((language.CHANGE_AT_SENTENCE if fresh[at + k] else language.CHANGE_INSIDE) * (p[k] != p[k - 1]) for k in range(1, n))  # noqa: B023, E731
        assert np.isclose(worth(path[at : at + n]), max(map(worth, itertools.product(range(3), repeat=int(n)))))
        at += n


def test_label_spellings(spark):
    rows = spark.createDataFrame([(x,) for x in ("en-US", "EN_gb", "English", " zho ", "n/a", "", None, "und", "chi", "pt-BR")], "l string")
    assert [r.c for r in rows.select(language.label_language(F.col("l")).alias("c")).collect()] == ["en", "en", "en", "zh", None, None, None, None, "zh", "pt"]


# p7
@pytest.fixture(scope="module")
def judge(spark):
    model, field = pairdefects.train(table(spark, "/root/testdata/sf0.01", "samples"))

    def run(raw, post="my inspiring charger arrived from Bocekisuca in 739 tickets, so hopeful right now. #tag"):
        import pandas as pd

        return next(pairdefects.tagger(model, field, iter([pd.DataFrame({"prediction_no": [1], "raw_output": [raw], "post": [post]})])))["defect"][0]

    return run


WHOLE = '{"visual_evidence": "x", "textual_evidence": "y", "explanation": "%s", "label": "sarcastic"}'


@pytest.mark.parametrize(
    ("raw", "defect"),
    [
        (None, "empty"), ("  ​", "empty"), ("```json\n{}\n```", "empty"), (WHOLE % "N/A", "empty"), ("<think>hm</think>", "empty"), ("<think>still going", "truncated"), (WHOLE[:60], "truncated"),
        (WHOLE % "The author sounds happy about the charger, so the statement", "truncated"), ("I'm sorry, but I cannot help with this request.", "refusal"), (WHOLE % "I must decline to analyse this post.", "refusal"),
        (WHOLE % "My inspiring charger arrived from Bocekisuca in 739 tickets, so hopeful now.", "copy"), (WHOLE % "Wer hat eigentlich den Drucker vor dem Kaffee repariert? Der alte Garten ist schön.", "other_language"),
        (WHOLE % "The author says sorry, but the camera shows no regret at all.", None), ("```json\n" + WHOLE % "The caption treats the long wait as good news." + "\n```", None),
    ],
)
def test_defects(judge, raw, defect):
    got = judge(raw)
    assert (got if isinstance(got, str) else None) == defect


def test_refusal_late_in_a_long_clause(judge):
    long = "While the picture that was sent along shows two people who sit on a bench by the river and look at a boat that slowly drifts past them in the evening"
    assert judge(WHOLE % (long + ", I am sorry but I cannot help with this request and I must decline to answer.")) == "refusal"
    assert judge(WHOLE % (long + ".")) is None


def test_a_broken_object_is_tagged_unfinished_by_the_field(spark):
    import pandas as pd

    model, field = pairdefects.train(table(spark, "/root/testdata/sf0.01", "samples"))
    raws = [WHOLE[:60], "<think>The author sounds happy. The caption praises the queue.", '{"visual_evidence": "a cat", "explanation": "The caption treats the long wait as good news. The', None, WHOLE % "The caption treats the long wait as good news."]
    out = next(pairdefects.tagger(model, field, iter([pd.DataFrame({"prediction_no": range(5), "raw_output": raws, "post": ["a post about a queue"] * 5})])))
    assert [d if isinstance(d, str) else None for d in out["defect"]] == ["truncated"] * 3 + ["empty", None]
    assert [t[-1] for t in out["tags"][:3]] == ["unfinished"] * 3 and out["tags"][3] == [] and set(out["tags"][4]) == {"answer"}


def test_field_learns_a_chain():
    rng = random.Random(0)
    data = []
    for _ in range(200):
        tags, ids = [rng.randint(0, 1)], []
        for _ in range(3):
            tags.append(1 - tags[-1])
        ids = [[100 + t] if k == 0 else [99] for k, t in enumerate(tags)]
        data.append((ids, tags))
    field = pairdefects.fit_field([i for i, _ in data], [t for _, t in data], rounds=60)
    assert field.tag([i for i, _ in data]) == [t for _, t in data]


# p8
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 .,'!\n中，é<|endoftext|> don'tssll"), max_size=200), st.integers(1, 40))
def test_tree_encoding_is_exact(text, leaf):
    tokenizer = tokenise.load(tokenise.TOKENIZER)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert tokenise.encode(tokenizer, text, leaf) == ids
    assert tokenise.decode(tokenizer, ids, 7) == text.encode()


def test_join_is_associative():
    a, b, c = (tokenise.leaf(t) for t in ("it's one, tw", "o three f", "our. five"))
    assert tokenise.join(tokenise.join(a, b), c) == tokenise.join(a, tokenise.join(b, c))


def test_whole_corpus_is_encoded_exactly(spark):
    """Every document of sf0.01 by the tree, against one call a text; counts and null and empty texts too."""
    rows = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r.ids for r in tokenise.encode_documents(rows).collect()}
    tokenizer, texts = tokenise.load(tokenise.TOKENIZER), {r.doc_id: r.text for r in rows.collect()}
    assert all(got[k] == (tokenizer.encode(t, add_special_tokens=False).ids if t else []) for k, t in texts.items())
    assert any(len(tokenise.windows(t)) > 3 for t in texts.values() if t)
    assert {r.doc_id: r.n_tokens for r in tokenise.token_counts(rows).collect()} == {k: len(v) for k, v in got.items()}


# p9
def test_mix_reaches_its_shares(spark):
    rng = random.Random(2)
    sized = spark.createDataFrame([(i, rng.choice(["big", "big", "big", "small"]), rng.randint(1, 300)) for i in range(4000)] + [(9000, "other", 5)], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([(" Big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mix_shares(sized, targets).collect()}
    assert set(report) == {"big", "small"} and all(abs(r.share - 0.5) < 0.02 and r.most_repeats <= r.max_repeats for r in report.values())
    assert {tuple(r) for r in mixing.mix(sized, targets).collect()} == {tuple(r) for r in mixing.mix(sized.repartition(7), targets).collect()}


# p10
def index_of(docs, idf, truth):
    terms, owner = abuse.windows(docs)
    vocabulary = np.unique(terms[terms >= 0])
    weights = abuse.Weights(vocabulary, idf[abuse._bucket(vocabulary)], idf)
    return terms, owner, abuse.BlockMaxIndex(terms, weights, truth(owner), owner, np.arange(len(docs)))


def test_block_max_search_equals_brute_force(monkeypatch):
    monkeypatch.setattr(abuse, "BLOCK", 16)  # many blocks, so that both phases run
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, 60, rng.integers(3, 30)), -1) for _ in range(150)]
    idf = rng.random(abuse.COUNT_BUCKETS).astype(np.float32) + 0.1
    terms, _, index = index_of(docs, idf, lambda owner: (owner % 3 == 0).astype(float))
    examples = np.unique(terms, axis=0)
    asked = terms[::25]
    at, weights = index.weights.of(asked)
    dense, full = index.weights.of(examples)[1], np.zeros((len(examples), len(index.weights.vocabulary)))
    for row, (e, d) in enumerate(zip(examples, dense, strict=True)):
        full[row, index.weights.look_up(e[e >= 0])] = d[e >= 0]
    for hot in (False, True):
        window, found, cosines = index.search(at, weights, 7, 0.2, hot=hot)
        for w in range(len(asked)):
            brute = sum(full[:, i] * x for i, x in zip(at[w], weights[w], strict=True) if i >= 0)
            if not hot:
                best = np.sort(brute[brute >= 0.2])[::-1][:7]
                assert np.allclose(cosines[window == w], best, atol=1e-5)
            assert not hot or (index.labels[found[window == w]] > 0.5).all()


def test_windows_are_as_described():
    docs = [np.array([*range(1, 14), -1, 20, 21, -1]), np.array([], int), np.array([-2, *range(1, 15), -1])]
    terms, owner = abuse.windows(docs)
    words_ = [sorted(t for t in row if 0 <= t < 1 << 31) for row in terms]
    assert words_ == [[*range(1, 9)], [*range(5, 13)], [*range(6, 14)], [20, 21], [*range(1, 13)], [*range(3, 15)]] and owner.tolist() == [0, 0, 0, 0, 2, 2]


def test_level_is_the_highest_that_is_as_good():
    score = np.array([0.9] * 50 + [0.4] * 2 + [0.1] * 50)
    toxic = np.array([1] * 50 + [1, 0] + [0] * 50)
    level, (f1, precision, recall) = abuse.level_of(score, toxic, np.ones(102))
    assert 0.4 < level < 0.9 and precision == 1 and recall > 0.97 and f1 > 0.98
    assert abuse.level_of(np.zeros(0), np.zeros(0), np.zeros(0)) == (0.5, None)


def test_spelling_tricks():
    same = lambda a, b: abuse.sentence_ids(a) == abuse.sentence_ids(b)
    assert same("what trrrrash", "WHAT TRASH") and same("you b@$t@rd", "you bastard") and same("an i-d-i-o-t here", "an idiot here") and same("a <b>word</b> &amp; more", "a word & more")


def test_far_abusive_neighbours_vote():
    examples = [np.array([1, 2, 3, *range(1000 + 10 * k, 1003 + 10 * k), -1]) for k in range(10)]
    *_, index = index_of(examples, np.ones(abuse.COUNT_BUCKETS, np.float32), lambda owner: np.ones(len(owner)))
    score, evidence, cosine = abuse.score_documents(index, [np.array([1, 2, 3, *range(500, 505), -1])])
    assert abs(cosine[0] - 5 / 165**0.5) < 1e-5 and 0.7 < score[0] < 0.8 and evidence[0] >= 0


def test_abuse_on_labelled_documents(spark):
    documents, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    words_ = abuse.cut(documents.select("doc_id", abuse.clean_source("source").alias("source"), "text").mapInPandas(abuse._worded, "doc_id long, source string, words array<int>"))
    index, level = abuse.build(words_, labels)
    f1, precision, recall = index.quality  # each document is left out of its own vote
    assert 0 < level < 1 and precision > 0.85 and recall > 0.65
