import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quartergrid.llm.alignment import aligned, alignment_digest, token_groups

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_of_letter():
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain:
    """Whole texts, token by token: the operator's meaning without slices, stretches or pointers."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.letters = byte_of_letter()

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        spelled_a = [bytes(self.letters[x] for x in self.a.id_to_token(i)) for i in a]
        b = self.b.encode(text)
        spelled_b = []
        for i in b:
            piece = self.b.id_to_piece(i)
            is_byte = len(piece) == 6 and piece.startswith("<0x")
            spelled_b.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode())
        wanted = (" " + text).encode()
        if b"".join(spelled_a) != wanted or b"".join(spelled_b) != wanted:
            return None
        return list(zip(a, map(len, spelled_a))), list(zip(b, map(len, spelled_b)))

    def groups(self, text):
        found = self.tokens(text) if text else None
        if found is None:
            return []
        ends = []
        for side in found:
            at, own = 0, {}
            for token, length in side:
                at += length
                own[at] = token
            ends.append(own)
        groups, now = [], ([], [])
        for end in sorted({*ends[0], *ends[1]}):
            for side in (0, 1):
                if end in ends[side]:
                    now[side].append(ends[side][end])
            if end in ends[0] and end in ends[1]:
                groups.append(now)
                now = ([], [])
        return groups


def brute(docs):
    plain = Plain()
    groups = [plain.groups(text) for _, text in docs]
    links = [[(a[-1], b[-1]) for a, b in g] for g in groups]
    counts = Counter(pair for doc in links for pair in doc)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (doc_id, _), g, own in zip(docs, groups, links):
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((
            doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own),
            sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own),
            hashlib.sha256(written.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=repr)


def rows(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


WHITE = [
    " two  spaces", "three   in a row", "tail ", "tail  ", " ", "   ", "a\n \nb", "a\n  b\n", "\ttab\t x",
    "no break wide　ideographic ​ zero", "\x1c control \x1d", "a▁ b", "▁x", "<unk> <s> </s>", "<0x41>",
    "it's we'll  they 'd", "naïve café ﬁ ½ ", "日本語のテキスト と 漢字", "🙂🙂 👩‍👩‍👧", "\x00null", "x" * 5000,
]


def test_white_space_and_markers(spark):
    docs = list(enumerate([*WHITE, *(f"again {w} and {w}" for w in WHITE), None, ""]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(alignment_digest(frame, A, B)) == brute(docs)


def test_edges_and_rare_pairs_match_whole_texts(spark, edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    wanted = brute(docs)
    assert rows(alignment_digest(edge_docs, A, B)) == wanted
    assert rows(alignment_digest(edge_docs, A, B, head=3)) == wanted
    assert alignment_digest(no_docs, A, B).collect() == []


def test_groups_cover_the_text(spark, edge_docs):
    plain = Plain()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect() if r["doc_id"] != 9}
    for doc_id in (1, 8, 10):
        found = token_groups(edge_docs.where(edge_docs["doc_id"] == doc_id), A, B).orderBy("group").collect()
        assert [(r["ids_a"], r["ids_b"]) for r in found] == plain.groups(texts[doc_id])
        assert [r["start"] for r in found] == [0, *accumulate(r["bytes"] for r in found)][:-1]
        assert found[-1]["start"] + found[-1]["bytes"] == len((" " + texts[doc_id]).encode())


def test_links_are_stored_as_one_value_a_text(spark):
    docs = spark.createDataFrame([(1, " two words\n"), (2, None), (3, "two")], "doc_id long, text string")
    stored = {r["doc_id"]: r for r in aligned(docs, A, B).collect()}
    assert {i: len(r["links"]) for i, r in stored.items()} == {i: 8 * r["n_groups"] for i, r in stored.items()}
    assert stored[1]["n_groups"] > 0 and stored[2]["links"] == b""
