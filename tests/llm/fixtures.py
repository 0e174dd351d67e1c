"""Small documents with nulls, empty texts, ties, repeated rows, copies, and a long text."""

import random

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "a"), (904, "a"), (None, "no id here but words " * 5), (905, "x " * 5000), (906, "one two\x1ethree four\x85five six seven " * 4), (907, "Ünïcode wörds ▁ and 😀 emoji\n\n" * 3)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(r.choice(words) for _ in range(20)) for _ in range(4)]
    lines = [" ".join(r.choice(words) for _ in range(12)) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 6)):
            x = r.random()
            body = [r.choice(words) for _ in range(r.randint(1, 40))]
            if x < 0.2:
                body[len(body) // 2 : len(body) // 2] = r.choice(passages).split()
            line = r.choice([" ", "  "]).join(body)
            if x > 0.6:
                line = r.choice(lines)
                if r.random() < 0.5:
                    at = r.randrange(len(line))
                    line = line[:at] + r.choice(["", "z", line[at] + "q"]) + line[at + 1 :]
            parts.append(line)
        out.append((i, "\n".join(parts)))
    for i in range(n, n + 12):  # copies, some with an edit
        text = out[r.randrange(n)][1]
        out.append((i, text if i % 2 else text.replace("w7", "w8", 1)))
    out.append(out[3])  # a repeated row
    return out + ODD


def frame(spark, rows=None):
    """documents with columns that clash with the operators' own."""
    rows = documents() if rows is None else rows
    more = [(i, t, f"s{(i or 0) % 3}" if (i or 0) % 7 else None, 1.5, [1], 2, 3, "b") for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, source string, score double, spans array<int>, size int, g int, bucket string")


def unlike(spark):
    return frame(spark, [])
