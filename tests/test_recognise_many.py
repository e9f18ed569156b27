import numpy as np

from corpuslens.operators import recognise as S

TEXTS = ["", None, " ", "...", "Hi.\n There! x", "a.b c. D'e-f? g", "In 1900 the War of Peru ended. King Rex spoke.", "King Rex spoke. In 1900 the War of Peru ended.", "é. Ä!b ?"] * 3


def test_pieces_have_the_sentences_tokens():
    for text in TEXTS:
        own = [[(m.group(), start + m.start()) for m in S.TOKENS.finditer(p)] for p, start in S.pieces_of(text or "")]
        assert [t for t in own if t] == S.sentences(text or "")


def test_sentences_at_once_have_the_paths_of_each(monkeypatch):
    rng = np.random.default_rng(1)
    labels = ["DATE", "LOC"]
    tags = S.tags_of(labels)
    moves = S.forbidden(tags)
    moves = moves + np.where(np.isinf(moves), 0, rng.normal(size=moves.shape))
    weights = rng.normal(size=(1 << 10, len(tags))).astype(np.float32)
    want = []
    for i, text in enumerate(TEXTS):
        for tokens in S.sentences(text or ""):
            path = S.best_tags(S.features([w for w, _ in tokens], 1 << 10), weights, moves)
            for k, tag in enumerate(path):
                if tags[tag][0] == "B":
                    last = k
                    while last + 1 < len(path) and tags[path[last + 1]] == f"I-{tags[tag][2:]}":
                        last += 1
                    a, b = tokens[k][1], tokens[last][1] + len(tokens[last][0])
                    want.append((i, (text[a:b], tags[tag][2:], a, b)))
    made, seen = S.Spans(labels, weights, moves), []
    monkeypatch.setattr(S, "features", lambda words, size, f=S.features: (seen.append(tuple(words)), f(words, size))[1])
    at, found = made(TEXTS)
    assert want and list(zip(at, found, strict=True)) == want
    assert len(seen) == len(set(seen))  # copies are looked up
    monkeypatch.setattr(S, "KNOWN", 0)
    assert list(zip(*made(TEXTS), strict=True)) == want
