"""BPE encoding and decoding, whole texts of any length.

The merges themselves are the tokenizers library's. Around it:

* White space never is part of a token of this kind of vocabulary (the file's
  normaliser and pre-tokeniser are checked for that), so a text is the sequence of
  its white-space-free words, and a word met before is looked up, not merged again.
* A long text is encoded as a tree: it is cut into halves down to leaves, wherever
  the cut falls; leaves are rows of their own and are encoded in parallel by any
  task. Two neighbours are then joined: a window around the cut is encoded again and
  grown until it shares a token, at the same place, with either side. What lies
  between is taken from the window. Only the ends of a leaf keep the places of their
  tokens for that.

Why one shared token is enough: tokens are an encoding of a word exactly if each two
neighbours are the encoding of what they spell. Left of the shared token all neighbours
are neighbours in the left part, from it on in the window, and none of them touches the
end that was cut into the left part or the window. Where a word ends, the text alone
says: a run of letters or of other signs ends at the first sign of another kind,
wherever one began to read it. Around added tokens, and for other kinds of vocabulary,
a shared token counts only next to white space.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import slices, text_or_empty
from lakelens.session import stage

#: Texts of more code points than this are encoded as trees with leaves of this size.
LEAF = 1 << 15

#: Code points of a leaf's ends that keep their tokens' places, at least.
EDGE = 256

#: Words whose codes a task keeps; the table is emptied when it is full.
_KEPT = 1 << 18

#: Words of letters that are encoded as one text.
TOGETHER = 128

#: New words that are encoded together.
LEARNED = 1 << 14

#: Bytes of short texts whose words are looked up together; their codes take four times that.
BYTES = 1 << 20

#: Encoded leaves that are Python's strings at a time.
ROWS = 16

# White space as the library's patterns see it.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


def tokenizer_json(path: str) -> str:
    """The tokenizer file with truncation and padding off."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    spec["truncation"] = spec["padding"] = None
    return json.dumps(spec)


def splits_at_spaces(spec: str) -> bool:
    """Whether words can be encoded one by one: every span of white space becomes one
    space, and the pre-tokeniser drops it between pieces."""
    d = json.loads(spec)
    steps = (d.get("normalizer") or {}).get("normalizers", [])
    squeezed = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} for s in steps)
    plain = {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"}
    pre = (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    cut = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert")
    tight = not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in d.get("added_tokens", ()))
    return squeezed and plain and bool(cut) and tight and d.get("post_processor") is None and d.get("decoder") is None


def neighbours_decide(spec: str) -> bool:
    """Whether neighbouring tokens alone decide if an encoding is right: plain byte pairs."""
    model = json.loads(spec)["model"]
    return model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "fuse_unk", "continuing_subword_prefix"))


class Encoder:
    """Codes of texts, with the words met so far."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.token = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.by_word = splits_at_spaces(spec)
        self.by_pair = self.by_word and neighbours_decide(spec)
        added = json.loads(spec).get("added_tokens", ())
        self.added = {t["content"].lower() for t in added}
        self.tail = json.loads(spec)["model"].get("end_of_word_suffix")
        most = max(self.token, default=-1) + 1
        self.last = [bool(self.tail) and self.token.get(i, "").endswith(self.tail) for i in range(most)]
        self.spelled = [pa.array([str(i) for i in range(most)], pa.string()),
                        pa.array([self.token.get(i, "") for i in range(most)], pa.string())]
        self.again = 0  # code points encoded again by joins
        self._forget()

    def _forget(self) -> None:
        """No words are known: their spellings, numbers of ids, ids and decoded texts."""
        self.known, self.counts = pa.array([], pa.string()), np.empty(0, np.int64)
        self.codes = [pa.array([], pa.string()), pa.array([], pa.string())]

    def _decoded(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def _ids(self, new: list[str]) -> list[list[int]]:
        """Ids of each word.

        Words of letters alone are encoded many to a text, which takes the library half
        the time: each has one token that ends a word, its last. A text in which there are
        more or fewer of those than words goes word by word, as all other words do.
        """
        plain = [n for n, w in enumerate(new) if self.tail and w.isalpha()]
        out: list = [None] * len(new)
        runs = [plain[i:i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        texts = [" ".join([new[n] for n in run]) for run in runs]
        for run, code in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = code.ids
            cuts = [n + 1 for n, i in enumerate(ids) if self.last[i]]
            if len(cuts) == len(run) and cuts[-1] == len(ids):
                for n, start, end in zip(run, [0, *cuts], cuts):
                    out[n] = ids[start:end]
        rest = [n for n, x in enumerate(out) if x is None]
        for n, code in zip(rest, self.tokenizer.encode_batch_fast([new[n] for n in rest], add_special_tokens=False)):
            out[n] = code.ids
        return out

    def _learn(self, new: pa.Array) -> None:
        ids = self._ids(new.to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        taken = pa.array(np.fromiter((i for x in ids for i in x), np.int64, ends[-1]))
        bounds = pa.array(ends.astype(np.int32))
        # without a decoder step, decode() is the tokens' own texts
        texts = [pc.binary_join(pa.ListArray.from_arrays(bounds, each.take(taken)), " ") for each in self.spelled]
        self.known = pa.concat_arrays([self.known, new])
        self.counts = np.concatenate([self.counts, np.diff(ends)])
        self.codes = [pa.concat_arrays([have, t]) for have, t in zip(self.codes, texts)]

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text), by the library alone."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)), self._decoded(ids)

    def encode_many(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """``encode`` of each text."""
        return list(zip(*(c.to_pylist() for c in self.encode_columns(texts))))

    def encode_columns(self, texts: pa.Array) -> list[pa.Array]:
        """``encode`` of each text as three columns, which never are Python's strings;
        words are split, numbered and looked up by Arrow.

        Texts with control signs at which Arrow splits and the vocabulary does not are
        left to the library.
        """
        texts = texts.fill_null("")
        if not self.by_word:
            return _columns([self.encode(t) for t in texts.to_pylist()])
        odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]")
        split = pc.utf8_split_whitespace(texts)
        ends = np.asarray(split.offsets)
        ends = ends - ends[0]
        coded = split.flatten().dictionary_encode()
        code = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        # a library decode joins tokens by one space; a word without tokens adds none
        some = self.counts[code] > 0
        bounds = pa.array(np.concatenate([[0], np.cumsum(some)])[ends].astype(np.int32))
        sums = np.concatenate([[0], np.cumsum(self.counts[code])])
        spelled = pa.array(code[some])
        out = [pa.array(np.diff(sums[ends]), pa.int64())] + [
            pc.binary_join(pa.ListArray.from_arrays(bounds, each.take(spelled)), " ") for each in self.codes]
        by_library = texts.filter(odd).to_pylist()
        if by_library:
            out = [pc.replace_with_mask(have, odd, c)
                   for have, c in zip(out, _columns([self.encode(t) for t in by_library]))]
        return out

    def _numbers(self, found: pa.Array) -> np.ndarray:
        """The number of each word in the table; new words enter it."""
        at = pc.index_in(found, self.known)
        if at.null_count + len(self.known) > _KEPT:
            self._forget()
            at = pc.index_in(found, self.known)
        known, new = len(self.known), found.filter(at.is_null())
        for start in range(0, len(new), LEARNED):
            self._learn(new.slice(start, LEARNED))
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        out[out < 0] = np.arange(known, known + len(new))
        return out

    def spans(self, text: str, start: int) -> list[tuple[int, int, int]]:
        """(id, begin, end) per token, places counted from ``start``."""
        code = self.tokenizer.encode(text, add_special_tokens=False)
        return [(i, a + start, b + start) for i, (a, b) in zip(code.ids, code.offsets)]

    def join(self, text: str, left: list, right: list, ends: tuple[int, int, int], window: int = 64,
             inner: tuple[bool, bool] = (False, False)) -> list | None:
        """Tokens of a part of a text from those of its halves; ``ends``: begin, cut, end.

        The window agrees with the left part where both have the same token at the same
        place, short of the cut and next to white space unless neighbours decide alone;
        likewise on the right. A part whose agreement is its outer end agrees by itself,
        unless that end is said to be ``inner``: tokens beyond it are not at hand. If it
        takes those to agree, there is no result.
        """
        lo_text, cut, hi_text = ends
        alone = self.by_pair and self._plain(text)
        while True:
            lo = max(lo_text, cut - window)
            hi = min(hi_text, cut + window)
            middle = self.spans(text[lo:hi], lo)
            self.again += hi - lo
            i, j = (0, 0) if lo == lo_text and not inner[0] else self._agree_left(text, left, middle, lo, cut, alone)
            k, m = ((len(right), len(middle)) if hi == hi_text and not inner[1]
                    else self._agree_right(text, right, middle, hi, cut, alone))
            if i is not None and k is not None and j <= m:
                return left[:i] + middle[j:m] + right[k:]
            if lo == lo_text and hi == hi_text:
                return None if any(inner) else middle
            window *= 2

    def _plain(self, text: str) -> bool:
        """Whether no added token is in ``text``: those end words whatever stands before them."""
        low = text.lower()
        return not any(t in low for t in self.added)

    @staticmethod
    def _seam(text: str, token: tuple[int, int, int], lo: int, alone: bool) -> bool:
        """Whether a token may be shared at all."""
        return alone or (token[1] > lo and _SPACES.match(text[token[1] - 1]) is not None)

    @staticmethod
    def _placed(tokens: list) -> dict:
        """Tokens that share no character with a neighbour, and their numbers."""
        last = len(tokens) - 1
        return {t: n for n, t in enumerate(tokens)
                if (n == 0 or tokens[n - 1][2] <= t[1]) and (n == last or tokens[n + 1][1] >= t[2])}

    def _agree_left(self, text, left, middle, lo, cut, by_pair):
        """Places (i in left, j in middle) from which the window is taken."""
        near = next((n for n in range(len(left), 0, -1) if left[n - 1][1] < lo), 0)
        at = {t: n + near for t, n in self._placed(left[near:]).items()}
        alone = self._placed(middle)
        for j, token in enumerate(middle):
            if token[2] >= cut:
                break
            if token in at and token in alone and self._seam(text, token, lo, by_pair):
                return at[token], j
        return None, None

    def _agree_right(self, text, right, middle, hi, cut, by_pair):
        """Places (k in right, m in middle) before which the window is taken."""
        far = next((n for n, t in enumerate(right) if t[1] >= hi), len(right))
        at, alone = self._placed(right[:far]), self._placed(middle)
        for m in range(len(middle) - 1, -1, -1):
            token = middle[m]
            if token[1] <= cut:
                break
            if token[2] < hi and token in at and token in alone and self._seam(text, token, 0, by_pair):
                return at[token], m
        return None, None

    def tree(self, text: str, cuts: list[int], leaves: list[list], inner: tuple[bool, bool] = (False, False)) -> list | None:
        """Joins neighbouring leaves, then neighbouring pairs, up to the whole; ``inner``
        says whether the first leaf's left end and the last one's right end are."""
        parts = list(zip(cuts, [*cuts[1:], len(text)], leaves))
        while len(parts) > 1:
            joined = []
            for n in range(0, len(parts) - 1, 2):
                a, b = parts[n], parts[n + 1]
                sides = inner[0] and n == 0, inner[1] and n + 2 == len(parts)
                tokens = self.join(text, a[2], b[2], (a[0], b[0], b[1]), inner=sides)
                if tokens is None:
                    return None
                joined.append((a[0], b[1], tokens))
            parts = joined + parts[len(joined) * 2:]
        return parts[0][2] if parts else []


def leaf_cuts(length: int, leaf: int) -> list[int]:
    """Where leaves begin if halves are halved until none is longer than ``leaf``."""
    out = [(0, length)]
    while max(b - a for a, b in out) > leaf:
        out = [p for a, b in out for p in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return [a for a, _ in out]


_CODES = "doc_id bigint, n_tokens bigint, ids string, decoded string"


_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _short(spec: str, hashed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec)
        for batch in batches:
            for part in slices(batch, "text", BYTES):
                yield _coded(part.column("doc_id"), encoder.encode_columns(part.column("text")), hashed)
                pa.default_memory_pool().release_unused()  # an executor has a worker for each core
    return run


def _columns(codes: list[tuple[int, str, str]]) -> list[pa.Array]:
    counts, ids, decoded = zip(*codes) if codes else ((), (), ())
    return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]


def _coded(doc_ids: pa.Array, codes: list[pa.Array], hashed: bool) -> pa.RecordBatch:
    """Codes as they are, or only their digests: those are all that leaves the task."""
    counts, *texts = codes
    if hashed:
        texts = [pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in column], pa.string()) for column in texts]
    names = ("ids_sha256", "decoded_sha256") if hashed else ("ids", "decoded")
    return pa.record_batch({"doc_id": doc_ids, "n_tokens": counts, **dict(zip(names, texts))})


_LEAF = "row bigint, doc_id bigint, leaf int, start bigint, part string"


def _cut(leaf: int):
    def run(batches):
        for batch in batches:
            for few in slices(batch, "text"):
                for row, doc, text in zip(*(few.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                    cuts = leaf_cuts(len(text), leaf)
                    yield pa.record_batch({
                        "row": pa.array([row] * len(cuts), pa.int64()), "doc_id": pa.array([doc] * len(cuts), pa.int64()),
                        "leaf": pa.array(range(len(cuts)), pa.int32()), "start": pa.array(cuts, pa.int64()),
                        "part": pa.array([text[a:b] for a, b in zip(cuts, [*cuts[1:], None])], pa.string())})
    return run


_ENCODED = ("row bigint, doc_id bigint, leaf int, part string, head string, head_spans array<bigint>, n bigint, "
            "ids string, decoded string, tail string, tail_spans array<bigint>")
_ENCODED_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.int32()), ("part", pa.string()), ("head", pa.string()),
    ("head_spans", pa.list_(pa.int64())), ("n", pa.int64()), ("ids", pa.string()), ("decoded", pa.string()),
    ("tail", pa.string()), ("tail_spans", pa.list_(pa.int64()))])


def ends(text: str) -> tuple[int, int]:
    """Where the middle of a leaf begins and ends: at white space, ``EDGE`` or more from
    the leaf's ends. Without such places both are the end of the text."""
    first = _SPACES.search(text, EDGE)
    if first is None:
        return len(text), len(text)
    last = max(text.rfind(c, first.end(), max(0, len(text) - EDGE)) for c in " \n")
    return (first.start(), last) if last > first.start() else (len(text), len(text))


def _flat(spans: list, start: int = 0) -> list[int]:
    return [x for i, a, b in spans for x in (i, a - start, b - start)]


def _unspaced(encoder: Encoder, text: str) -> dict:
    """A leaf without white space, encoded whole; ends and middle meet between two tokens.

    ``part`` keeps the text, for the case that a join takes more than an end.
    """
    spans = encoder.spans(text, 0)
    a = next((n for n, t in enumerate(spans) if t[1] >= EDGE), len(spans))
    b = next((n for n in range(len(spans), 0, -1) if spans[n - 1][1] < len(text) - EDGE), 0)
    if not encoder.by_pair or a >= b or spans[a - 1][2] > spans[a][1] or spans[b - 1][2] > spans[b][1]:
        return {"part": text, "head": text, "head_spans": _flat(spans)}
    middle = [t[0] for t in spans[a:b]]
    return {"part": text, "head": text[:spans[a][1]], "head_spans": _flat(spans[:a]),
            "n": len(middle), "ids": " ".join(map(str, middle)), "decoded": encoder._decoded(middle),
            "tail": text[spans[b][1]:], "tail_spans": _flat(spans[b:], spans[b][1])}


def _leaves(spec: str):
    def run(batches):
        encoder = Encoder(spec)
        for batch in batches:
            for piece in slices(batch, "part", BYTES):
                out, rows = [], piece.to_pylist()
                spots = [ends(x["part"]) if encoder.by_word else (0, 0) for x in rows]
                codes = encoder.encode_many(pa.array([x["part"][a:b] for x, (a, b) in zip(rows, spots)], pa.string()))
                for x, (a, b), code in zip(rows, spots, codes):
                    text = x["part"]
                    row = {k: x[k] for k in ("row", "doc_id", "leaf")}
                    if a < b:
                        row |= dict(zip(("n", "ids", "decoded"), code))
                        row |= {"head": text[:a], "head_spans": _flat(encoder.spans(text[:a], 0)),
                                "tail": text[b:], "tail_spans": _flat(encoder.spans(text[b:], 0))}
                    else:
                        row |= _unspaced(encoder, text)
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=_ENCODED_ARROW)
                pa.default_memory_pool().release_unused()
    return run


def _joined(spec: str, hashed: bool):
    """Rows come sorted by (row, leaf): the leaves of one text follow each other."""
    def run(batches):
        encoder = Encoder(spec)

        def stretch(parts: list[tuple[str, list]], inner: tuple[bool, bool]) -> tuple[int, str, str] | None:
            """Codes of ends and whole leaves that follow each other without a middle."""
            cuts, leaves, at = [], [], 0
            for text, spans in parts:
                cuts.append(at)
                leaves.append([(i, a + at, b + at) for i, a, b in zip(spans[::3], spans[1::3], spans[2::3])])
                at += len(text)
            tokens = encoder.tree("".join(t for t, _ in parts), cuts, leaves, inner)
            if tokens is None:
                return None
            ids = [t[0] for t in tokens]
            return len(ids), " ".join(map(str, ids)), encoder._decoded(ids)

        def codes_of(leaves) -> list | None:
            """Stretches and middles in turn; a middle that does not end at white space
            makes the stretch before it and the one after it end inside."""
            codes, parts, before = [], [], False
            for x in leaves:
                parts.append((x["head"], x["head_spans"]))
                if x["tail"] is not None:
                    inside = x["part"] is not None
                    codes += [stretch(parts, (before, inside)), (x["n"], x["ids"], x["decoded"])]
                    parts, before = [(x["tail"], x["tail_spans"])], inside
            codes.append(stretch(parts, (before, False)))
            return None if None in codes else codes

        def whole(leaves):
            codes = codes_of(leaves)
            if codes is None:  # an end was too short to agree: leaves without white space are taken whole
                codes = codes_of([x if x["part"] is None else x | {
                    "head": x["part"], "head_spans": _flat(encoder.spans(x["part"], 0)), "tail": None} for x in leaves])
            codes = [c for c in codes if c[0]]
            code = sum(c[0] for c in codes), " ".join(c[1] for c in codes), " ".join(c[2] for c in codes)
            return _coded(pa.array([leaves[0]["doc_id"]], pa.int64()), _columns([code]), hashed)

        held = []
        for batch in batches:
            for x in (x for few in slices(batch, "ids", rows=ROWS) for x in few.to_pylist()):
                if held and x["row"] != held[0]["row"]:
                    yield whole(held)
                    held = []
                held.append(x)
        if held:
            yield whole(held)
    return run


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text.

    ``ids`` are decimal, joined by one space; ``decoded`` is what the library's
    decode() makes of them, special tokens included. Null texts are empty and have
    no ids. Repeated rows and null ids give a row each; an empty table gives none;
    other columns are not read. ``path`` is read by the driver only.
    """
    return _encoded(docs, path, leaf, False)


def encode_digests(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` gives,
    taken where the codes are made."""
    return _encoded(docs, path, leaf, True)


def _encoded(docs: DataFrame, path: str, leaf: int, hashed: bool) -> DataFrame:
    spec, fields = tokenizer_json(path), _DIGESTS if hashed else _CODES
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    is_long = F.length("text") > leaf
    short = source.where(~is_long).mapInArrow(_short(spec, hashed), fields)
    cut = source.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # written, so that the two uses of a row's number see the same rows; long texts only
    cut = stage(cut.mapInArrow(_cut(leaf), _LEAF))
    spread = cut.repartition("row", "leaf").mapInArrow(_leaves(spec), _ENCODED)
    joined = spread.repartition("row").sortWithinPartitions("row", "leaf").mapInArrow(_joined(spec, hashed), fields)
    return short.unionByName(joined)


def digests(codes: DataFrame) -> DataFrame:
    return codes.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
