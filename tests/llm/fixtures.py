"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import duckdb
import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, key string"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents():
    rng = random.Random(5)
    license_line = "This Line Is Licensed to everyone who reads it, free of charge."
    passage = _words(rng, 60)
    base = [_words(rng, rng.randint(30, 120)) for _ in range(12)]
    texts = [None, "", "\n", "  \n\t", "one", "one two three", "x" * 30, "For " * 80, "é ü ß 中文 " * 12]
    for i, t in enumerate(base):
        texts.append(t)
        words = t.split()
        near = list(words)
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
        texts.append(t.replace(" ", "\n", 1) + "\n" + license_line + ("\r" if i % 2 else ""))
        texts.append(_words(rng, 20) + " " + passage + " " + _words(rng, 15))
    texts += [base[0]] * 3 + [base[1].upper()] + [license_line.upper() + "\n" + license_line]
    texts.append("\n".join(_words(rng, 50) for _ in range(400)) + "\n" + license_line)  # a long one
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 7, 0.5, "k") for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], rows[20]]  # repeated rows


def thue_morse(n, a, b):
    """Rows of this shape and their complements collide under every polynomial hash modulo 2**64."""
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)], [(b, a)[bin(i).count("1") % 2] for i in range(n)]


def colliding(first=0):
    rng = random.Random(8)
    other = lambda n: " ".join(f"o{rng.randint(0, 10**9)}" for _ in range(n))
    letters = ["".join(x) for x in thue_morse(4096, "a", "b")]
    rows = [" ".join(x) for x in thue_morse(2048, "left", "right")]
    same = [f"s{i}" for i in range(34)]
    with_word = [" ".join([*same[:17], w, *same[17:]]) for w in letters]  # windows of 35 words that differ in that word
    texts = [*letters, *with_word, *rows, f"{other(40)} {rows[0]}", f"{other(40)} {letters[0]} {other(40)}", *["".join(x) for x in thue_morse(64, "cd", "ef")]]
    return [(first + i, t, None, None, None, None, None, None) for i, t in enumerate(texts)]


def with_null_ids():
    rows = documents()
    return rows + [(None, rows[9][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def benchmark():
    rows = documents()
    text = [r[1] for r in rows]
    return [(1, " ".join(text[12].split()[3:40])), (2, text[9].upper()), (3, "one, TWO three!"), (4, ""), (5, None), (None, text[13]), (10, " ".join(text[12].split()[5:18])), (10, "xxx"), (7, "For For For For")]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def sql(query, **tables):
    """Run DuckDB SQL over (rows, schema) tables."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        cols = [c.split() for c in schema.split(", ")]
        kinds = {"long": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[k]}' for c, k in cols)})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(cols))})", rows)
    out = con.execute(query)
    names = [d[0] for d in out.description]
    return [dict(zip(names, r)) for r in out.fetchall()]


def key(rows):
    return sorted(tuple((k, str(r[k])) for k in sorted(r)) for r in rows)


def same(df, expected):
    assert key([r.asDict() for r in df.collect()]) == key(expected)


def pdf(df):
    return pd.DataFrame([r.asDict() for r in df.collect()])
