"""Problem 7: broken prompt and response pairs.

A response's answer is cut into clauses and a linear-chain conditional random field tags each one as answer, refusal,
echo, foreign or unfinished, from the clause's words, its overlap with the post, the string kernel's verdict on its
language, how it ends and whether what it stands in (an object, a think block) ever ends. The clauses' shares of the words
decide the pair's defect; a response without clauses covers nothing and is empty. The field is fitted here on clause
sequences that are made up from phrase lists and from a bounded sample of posts.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import salted_left_join
from millrace.session import spread

from .canon import canonical
from .language import LANGUAGES, Model, label_language, sample_labelled
from .language import fit as fit_language
from .splits import sample_name
from .words import py_words

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Bound of the posts the field and the language kernel are fitted on, per language.
POSTS_PER_LANGUAGE = 250
#: Bound of the reference explanations whose clauses serve as sound answers.
SOUND_ROWS = 400
HASHED = 2048

# What stands for no answer.
PLACEHOLDERS = {"", "n/a", "na", "n.a.", "none", "null", "nil", "-", "--", "—", "...", "…", ".", "?", "tbd", "todo", "unknown", "empty", "placeholder", "[]", "{}", "string", "explanation", "no answer", "undefined", "nan"}
# Training phrases of refusals, and of proper answers that use the same words.
REFUSALS = """I'm sorry, but I can't help with that.|I am sorry, but I cannot assist with this request.|Sorry, I can't comply with this.|I cannot provide an analysis of this post.
I can't describe this image.|I am unable to analyse this content.|I'm not able to assist with that.|Unfortunately, I cannot classify this post.|Unfortunately I am unable to help here.
As an AI language model, I cannot judge this.|As an assistant I must refuse this task.|I must decline to answer.|I have to decline this request.|I won't be able to answer that.|I will not comment on this.
I would rather not answer this question.|I'd prefer not to discuss this.|I do not feel comfortable with this content.|I'm not comfortable analysing this picture.|This content violates my guidelines, so no answer is given.
This request goes against the policy and I cannot continue.|The content may be sensitive, so I decline.|My apologies, I cannot do that.|Apologies, but that is something I have to skip.|It would be inappropriate for me to respond.
I refuse to answer.|I can not help you with this one.|I'm afraid I can't do that.|I don't think I should comment on this post.|This is something I have to pass on.|No analysis can be given for this request.""".replace("\n", "|").split("|")
AFTER_REFUSAL = ["Please try another image.", "Is there anything else I can help with?", "Let me know if you have another question.", "Please consult a professional.", "Thank you for understanding."]
SUBJECTS = "the author|the writer|the caption|the image|the picture|the post|the tone|the wording|the contrast|the photo|the speaker|the text".split("|")
THINGS = "broken umbrella|long queue|cold coffee|empty train|new phone|wet lawn|old sofa|loud neighbour|late bus|burnt cake|tiny parking space|grey sky|dead plant|full inbox".split("|")
VERBS = "clashes with|supports|underlines|praises|contradicts|points to|agrees with|mocks|celebrates|plays down|sounds happy about|complains about".split("|")
USED_WORDS = """{S} says sorry, but {T} shows no regret.|{S} is unable to fix {T}, and the caption celebrates it.|{S} refuses to comment on {T}, which is the joke.|The line "I can't even" marks delight about {T}.
{S} cannot be taken literally because of {T}.|{S} declines the offer of {T} in jest.|Someone is not able to open {T}, so the praise is ironic.|"I am sorry" in the post is about {T}, not a real apology.""".replace("\n", "|").split("|")

_FENCE = regex.compile(r"^```[a-zA-Z]*\s*|\s*```$")
_CLAUSE = re.compile(r"[^.!?…。！？\n]*(?:[.!?…。！？]+(?![\"'”’)\s]|$|[\u2e80-\U0003ffff])[^.!?…。！？\n]*)*(?:[.!?…。！？]+[\"'”’)]*|\n+|$)")
_QUOTE = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»")
_WORDY = re.compile(r"[^\W_]")
_FIELD = regex.compile(r"[\"']explanation[\"']\s*:\s*[\"'](.*?)[\"']\s*[,}]", regex.S)
_ENDED = re.compile(r"[.!?…。！？)\]\"”’\u2600-\u27bf\U0001f300-\U0001faff][\"'”’)\]]*$")


def answer_of(raw: str | None) -> tuple[str, str]:
    """(answer text, state) of a raw output; state is 'whole', 'broken' (what the text stands in never ends) or 'empty'.

    Think blocks and fences are taken off; of a JSON object the explanation counts. A think block or an object that
    never ends is broken, its text is what there is of it; null, blank, placeholder and think-only outputs are empty.
    """
    text = canonical(raw or "").strip()
    if "</think>" in text:
        text = text.rsplit("</think>", 1)[1].strip()
    elif "<think>" in text:
        return text.rsplit("<think>", 1)[1].strip(), "broken"
    text = _FENCE.sub("", text).strip()
    if text.lower() in PLACEHOLDERS:
        return "", "empty"
    if text[0] not in "{[" and "{" in text and text.find('"', text.find("{")) > 0:
        inner = text[text.find("{") :]
        if "explanation" in inner:
            text = inner
    if text[0] in "{[":
        body = text
        if "}" in body and not body.endswith(("}", "]")):
            body = body[: body.rfind("}") + 1]
        try:
            value = json.loads(body, strict=False)
        except (ValueError, RecursionError):
            found = _FIELD.search(body)
            if found and body.rstrip().endswith("}"):
                value = {"explanation": found.group(1)}
            else:
                return body.rsplit(":", 1)[-1].strip(" \"',{["), "broken"
        if isinstance(value, list):
            value = next((v for v in value if isinstance(v, dict)), None)
        if not isinstance(value, dict):
            return "", "empty"
        told = value.get("explanation")
        text = canonical(told).strip() if isinstance(told, str) else ""
    return (text, "whole") if text.lower() not in PLACEHOLDERS and _WORDY.search(text) else ("", "empty")


def clauses(text: str) -> list[str]:
    return [c for c in (m.group().strip() for m in _CLAUSE.finditer(text)) if _WORDY.search(c)]


def _bin(share: float) -> int:
    return 0 if share < 0.3 else 1 if share < 0.5 else 2 if share < 0.65 else 3 if share < 0.8 else 4 if share < 0.92 else 5


def _own(clause: str) -> str:
    """The clause without what it quotes, if enough of its own is left."""
    if '"' not in clause and "“" not in clause and "«" not in clause:
        return clause
    own = _QUOTE.sub(" ", clause)
    return own if len(own.split()) >= 3 else clause


def features(parts: list[str], post: frozenset[str], foreign: list[int], broken: bool = False) -> list[list[int]]:
    """Feature ids of each clause; ``foreign`` is the binned lead of other languages over English, ``broken`` says that
    what the clauses stand in never ends.

    All words and word pairs of a clause are features, since they tell refusals from answers. They are left out where a
    clause is of another language or repeats the post: there they would only teach what posts are about.
    """
    words = [py_words(_own(p)) for p in parts]
    told = set().union(*words) if words else set()
    covers = len(told & post) / len(post) if post else 0.0
    alike = len(told & post) / len(told | post) if post else 0.0
    out = []
    for k, (part, own) in enumerate(zip(parts, words, strict=True)):
        n = len(own)
        held = sum(w in post for w in own) / n if n and post else 0.0
        ended = bool(_ENDED.search(part))
        at_end = k == len(parts) - 1
        ids = [0, 1 + _bin(held), 8 + _bin(covers), 16 + _bin(alike), 24 + 6 * min(3, _bin(held) // 2) + _bin(covers), 50 + foreign[k], 60 + 2 * at_end + ended, 66 + (k == 0), 70 + min(n, 5)]
        if at_end and not ended and alike < 0.5:
            ids.append(78)
        if at_end and broken:
            ids.append(79)
        if foreign[k] <= 1 and held < 0.8:
            ids += [100 + zlib.crc32(w.encode()) % HASHED for w in own]
            ids += [100 + zlib.crc32(f"{a} {b}".encode()) % HASHED for a, b in zip(own, own[1:])]
        out.append(ids)
    return out


def foreign_bins(model: Model, parts: list[list[str]], cache: dict[str, np.ndarray]) -> list[list[int]]:
    """Per response and clause: 0 for clearly English up to 4 for clearly another language, by kernel score."""
    flat = [py_words(_own(p)) or ["0"] for ps in parts for p in ps]
    new = list({w for ws in flat for w in ws} - cache.keys())
    if new:
        cache.update(zip(new, model.words(new), strict=True))
    sizes = np.array([len(ws) for ws in flat])
    scores = np.add.reduceat(np.array([cache[w] for ws in flat for w in ws]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
    english = LANGUAGES.index("en")
    lead = (np.delete(scores, english, axis=1).max(axis=1) - scores[:, english]) / np.maximum(1.0, np.sqrt(sizes))
    bins = iter(0 if x < -0.8 else 1 if x < 0.2 else 2 if x < 0.7 else 3 if x < 1.5 else 4 for x in lead)
    return [[next(bins) for _ in ps] for ps in parts]


class Field:
    """A linear-chain CRF over sparse binary features; ``weights`` (features, tags), ``moves`` (tags, tags)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def emissions(self, sequences: list[list[list[int]]]) -> np.ndarray:
        """(sequences, clauses, tags), padded with zeros."""
        longest = max(map(len, sequences))
        sizes = np.array([len(ids) for s in sequences for ids in s])
        flat = np.fromiter((i for s in sequences for ids in s for i in ids), np.int64, sizes.sum())
        rows = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        out = np.zeros((len(sequences), longest, len(TAGS)))
        mask = np.arange(longest) < np.array([len(s) for s in sequences])[:, None]
        out[mask] = rows
        return out

    def tag(self, sequences: list[list[list[int]]]) -> list[list[int]]:
        """Viterbi over a padded batch."""
        score = self.emissions(sequences)
        lengths = np.array([len(s) for s in sequences])
        best, back = score[:, 0], []
        for t in range(1, score.shape[1]):
            step = best[:, :, None] + self.moves
            back.append(step.argmax(axis=1))
            best = np.where((t < lengths)[:, None], step.max(axis=1) + score[:, t], best)
        path = [best.argmax(axis=1)]
        for t in range(score.shape[1] - 1, 0, -1):
            path.append(np.where(t < lengths, back[t - 1][np.arange(len(path[-1])), path[-1]], path[-1]))
        tags = np.array(path[::-1]).T
        return [tags[k, :n].tolist() for k, n in enumerate(lengths)]


def fit_field(sequences: list[list[list[int]]], tags: list[list[int]], rounds: int = 80, decay: float = 2e-3) -> Field:
    """Maximum likelihood by full-batch Adam; gradients by forward-backward."""
    k = len(TAGS)
    field = Field(np.zeros((100 + HASHED, k)), np.zeros((k, k)))
    lengths = np.array([len(s) for s in sequences])
    longest = lengths.max()
    mask = np.arange(longest) < lengths[:, None]
    sizes = np.array([len(ids) for s in sequences for ids in s])
    flat = np.fromiter((i for s in sequences for ids in s for i in ids), np.int64, sizes.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    touched, firsts = np.unique(flat[order], return_index=True)
    gold = np.zeros((len(sequences), longest, k))
    for n, path in enumerate(tags):
        gold[n, np.arange(len(path)), path] = 1
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    moment = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros_like(field.moves), np.zeros_like(field.moves)]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        score = field.emissions(sequences)
        ahead = np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], total(ahead[:, t - 1, :, None] + field.moves, 1) + score[:, t], ahead[:, t - 1])
        behind = np.zeros_like(score)
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], total(field.moves[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        norm = total(ahead[:, -1], 1)
        belief = np.exp(ahead + behind - norm[:, None, None]) * mask[:, :, None]
        moves = np.zeros((k, k))
        for t in range(1, longest):
            joint = ahead[:, t - 1, :, None] + field.moves + (score[:, t] + behind[:, t])[:, None, :] - norm[:, None, None]
            moves += (np.exp(joint) * mask[:, t, None, None]).sum(axis=0)
        error = (gold - belief)[mask]
        gradient = np.zeros_like(field.weights)
        gradient[touched] = np.add.reduceat(error[owner[order]], firsts, axis=0)
        for value, grad, m, v in ((field.weights, gradient / len(sequences) - decay * field.weights, 0, 1), (field.moves, (gold_moves - moves) / len(sequences) - decay * field.moves, 2, 3)):
            moment[m] = 0.9 * moment[m] + 0.1 * grad
            moment[v] = 0.99 * moment[v] + 0.01 * grad**2
            value += 0.15 * (moment[m] / (1 - 0.9**step)) / (np.sqrt(moment[v] / (1 - 0.99**step)) + 1e-8)
    return field


def _answer(rng: random.Random) -> str:
    s, t = rng.choice(SUBJECTS), rng.choice(["the ", "a "]) + rng.choice(THINGS)
    if rng.random() < 0.3:
        return rng.choice(USED_WORDS).format(S=s.capitalize(), T=t)
    tail = rng.choice(["", f" because of {rng.choice(SUBJECTS)}", f", so the statement about {rng.choice(THINGS)} reads literally", f" and {rng.choice(SUBJECTS)} {rng.choice(VERBS)} {t}"])
    return f"{s.capitalize()} {rng.choice(VERBS)} {t}{tail}."


def _edited(post: str, rng: random.Random) -> str:
    words = post.split(" ") if " " in post else list(post)
    share = rng.choice([0, 0, 0.05, 0.1, 0.15])
    kept = [rng.choice(["always", "today", "quite"]) if rng.random() < share / 2 else w for w in words if rng.random() >= share / 2]
    text = (" " if " " in post else "").join(kept)
    return text.lower() if rng.random() < 0.2 else regex.sub(r"[.,!?]", "", text) if rng.random() < 0.15 else text


def made_up(posts: list[str], codes: list[str], sound: list[str], rng: random.Random, count: int = 1800) -> list[tuple[str, list[str], list[int], bool]]:
    """(post, clauses, tags, broken) to fit on; ``sound`` are clauses of reference explanations. In a seventh, what the
    clauses stand in never ends, so the last one is unfinished whatever it says."""
    foreign = [p for p, c in zip(posts, codes, strict=True) if c != "en"] or ["Nichts ist so schön wie der alte Garten."]
    posts = posts or ["a post about a queue"]
    out = []
    for _ in range(count):
        post, kind = rng.choice(posts), rng.choice(["answer", "answer", "refusal", "echo", "foreign", "unfinished"])
        if kind == "refusal":
            parts = [(rng.choice(REFUSALS), 1)] + [(rng.choice(AFTER_REFUSAL), 1)] * (rng.random() < 0.3)
        elif kind == "echo":
            parts = [(p, 2) for p in clauses(canonical(_edited(post, rng)))]
        elif kind == "foreign":
            parts = [(p, 3) for p in clauses(canonical(rng.choice(foreign)))[: rng.randint(1, 3)]]
            parts = [(p if _ENDED.search(p) else p + ".", tag) for p, tag in parts]
        else:
            parts = [(rng.choice(sound) if sound and rng.random() < 0.6 else _answer(rng), 0) for _ in range(rng.randint(1, 3))]
            if kind == "unfinished":
                words = parts[-1][0].split(" ")
                cut = " ".join(words[: rng.randint(2, max(2, len(words) - 1))])
                parts[-1] = (cut[: rng.randint(max(3, len(cut) - 4), len(cut))].rstrip(" .,"), 4)
        broken = len(out) % 7 == 0
        if broken and parts:
            parts[-1] = (parts[-1][0], 4)
        if parts and parts[0][0]:
            out.append((canonical(post), [p for p, _ in parts], [t for _, t in parts], broken))
    return out


def sound_clauses(samples: DataFrame, most: int = SOUND_ROWS) -> list[str]:
    """Clauses of at most ``most`` reference explanations, by hash of the row number."""
    told = samples.select("line_no", F.col("reference_reasoning.explanation").alias("told")).where("length(told) > 20")
    rows = told.count()
    picked = told.where(F.expr("pmod(xxhash64(line_no), 1000000) / 1000000.0") < min(1.0, most / max(1, rows))).orderBy(F.expr("xxhash64(line_no, told)")).limit(2 * most).collect()
    return [c for r in picked for c in clauses(canonical(r["told"])) if _ENDED.search(c)]


def train(samples: DataFrame, per_language: int = POSTS_PER_LANGUAGE) -> tuple[Model, Field]:
    """The language kernel and the field, fitted on the driver on bounded samples of posts and reference explanations."""
    texts, codes = sample_labelled(samples, "line_no", "text", label_language(F.col("language")), per_language)
    sound, rng = sound_clauses(samples), random.Random(7)
    english = [_answer(rng) for _ in range(100)] + rng.sample(sound, min(len(sound), 300)) + REFUSALS
    rng.shuffle(english)
    model = fit_language(english + texts, ["en"] * len(english) + codes, landmarks=80)
    examples = made_up(texts, codes, sound, rng)
    bins = foreign_bins(model, [parts for _, parts, _, _ in examples], {})
    sequences = [features(parts, frozenset(py_words(post)), b, broken) for (post, parts, _, broken), b in zip(examples, bins, strict=True)]
    return model, fit_field(sequences, [tags for _, _, tags, _ in examples])


def verdict(parts: list[str], tags: list[int], broken: bool = False) -> str | None:
    """The defect that the clauses' shares of the words make, if any: no clauses cover nothing."""
    if not parts:
        return "empty"
    if broken and tags[-1] == 4:
        return "truncated"
    share = np.zeros(len(TAGS))
    for part, tag in zip(parts, tags, strict=True):
        share[tag] += max(1, len(py_words(part)))
    share /= share.sum()
    if share[1] > 0 and share[1] >= share[0]:
        return "refusal"
    if share[2] >= 0.6:
        return "copy"
    if share[3] >= 0.5:
        return "other_language"
    if tags[-1] == 4:
        return "truncated"
    return "refusal" if share[1] >= 0.5 else None


def tagger(model: Model, field: Field, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(prediction_no, raw_output, post) -> (prediction_no, defect, clauses as tagged)."""
    cache: dict[str, np.ndarray] = {}
    for pdf in batches:
        if len(cache) > 200_000:
            cache = {}
        answers = [answer_of(raw if isinstance(raw, str) else None) for raw in pdf["raw_output"]]
        parts = [[] if state == "empty" else clauses(text) or ([text or "…"] if state == "broken" else []) for text, state in answers]
        broken = [state == "broken" for _, state in answers]
        posts = [frozenset(py_words(canonical(p))) if isinstance(p, str) else frozenset() for p in pdf["post"]]
        defects: list[str | None] = [verdict([], [])] * len(pdf)
        tagged: list[list[str]] = [[] for _ in range(len(pdf))]
        open_ = [k for k, p in enumerate(parts) if p]
        bins = foreign_bins(model, [parts[k] for k in open_], cache) if open_ else []
        sequences = [features(parts[k], posts[k], b, broken[k]) for k, b in zip(open_, bins, strict=True)]
        for begin in range(0, len(open_), 2000):
            for k, tags in zip(open_[begin : begin + 2000], field.tag(sequences[begin : begin + 2000]), strict=True):
                defects[k] = verdict(parts[k], tags, broken[k])
                tagged[k] = [TAGS[t] for t in tags]
        yield pd.DataFrame({"prediction_no": pdf["prediction_no"], "defect": defects, "tags": tagged})


def posts_by_id(samples: DataFrame) -> DataFrame:
    """(id_key, post): the latest delivered text of each sample id; blank ids and null texts drop out."""
    rows = samples.select(sample_name(F.col("sample_id")).alias("id_key"), F.struct("collected_at", "line_no", "text").alias("x")).where("id_key is not null and x.text is not null")
    return rows.groupBy("id_key").agg(F.max("x").alias("x")).select("id_key", F.col("x.text").alias("post"))


def tagged(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """prediction_no, defect (null if none) and tags of each prediction. A prediction without a known post has no echo."""
    model, field = train(samples)
    shared = samples.sparkSession.sparkContext.broadcast((model, field))  # bounded by the sample
    rows = spread(predictions.select("prediction_no", "sample_id", "raw_output").withColumn("id_key", sample_name(F.col("sample_id"))))
    joined = salted_left_join(rows, posts_by_id(samples), "id_key").select("prediction_no", "raw_output", "post")
    return joined.mapInPandas(lambda batches: tagger(*shared.value, batches), "prediction_no long, defect string, tags array<string>")


def defective(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """p7_found: (prediction_no, defect) of each defective prediction, one defect each."""
    return tagged(predictions, samples).where("defect is not null").select("prediction_no", "defect")


def defect_report(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Clauses by tag, and predictions, per defect ('none' for sound ones)."""
    rows = tagged(predictions, samples).withColumn("defect", F.coalesce("defect", F.lit("none")))
    counts = (F.sum(F.expr(f"size(filter(tags, t -> t = '{name}'))")).cast("long").alias(f"{name}_clauses") for name in TAGS)
    return rows.groupBy("defect").agg(F.count(F.lit(1)).alias("predictions"), *counts)
