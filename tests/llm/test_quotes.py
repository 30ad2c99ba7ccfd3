"""Quotation linking against brute force, across conversations too, and in time that grows with the lines."""

import random
import re
import time
from collections import defaultdict

from lakewarden.llm import quotes

MAIL = "conv_id long, turn long, role string, text string"


def plain(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def parts(text):
    """(rank, place, normalised text)"""
    paragraphs, lines = re.split(r"\n[ \t]*\n", text), text.split("\n")
    found = [(0, 0, text), *((1, i, t) for i, t in enumerate(paragraphs) if len(paragraphs) > 1), *((2, i, t) for i, t in enumerate(lines) if len(lines) > 1)]
    return [(r, i, plain(t)) for r, i, t in found if plain(t)]


def split(text):
    levels, texts = [], []
    for line in text.split("\n"):
        level = re.match(r" ?((?:> ?)*)", line)[1].count(">")
        shown = line[re.match(r" ?((?:> ?)*)", line).end() :] if level else line
        if levels and levels[-1] == level:
            texts[-1] += "\n" + shown
        else:
            levels.append(level)
            texts.append(shown)
    return list(zip(levels, texts, strict=True))


def brute(rows):
    """(conv, turn): (text, n_quotes, n_linked, reply, root, depth, position)"""
    own, units, passages = {}, defaultdict(list), {}
    for conv, turn, _, text in rows:
        runs, key = split(text), (conv, turn)
        own[key] = "\n".join(t for level, t in runs if not level).strip("\n")
        for said in (*(t for level, t in runs if not level), own[key]):
            for _, _, t in parts(said):
                units[t].append(key)
        quoted = [(level, t) for level, t in runs if level]
        passages[key] = [(place, level, parts(t)) for place, (level, t) in enumerate(quoted) if parts(t)]

    def original(key, text):
        earlier = [k for k in units.get(text, ()) if k[0] == key[0] and k[1] < key[1]]
        if earlier:
            return max(earlier)
        first = min(units.get(text, [key]))
        return first if first[0] != key[0] else None

    linked = {key: [(place, level, next(filter(None, (original(key, t) for _, _, t in sorted(own_parts))), None)) for place, level, own_parts in found] for key, found in passages.items()}
    parent = {key: next((to for _, level, to in found if level == 1 and to), None) for key, found in linked.items()}
    placed = {}
    for key in own:
        way = [key]
        while (up := parent[way[-1]]) and up not in way:
            way.append(up)
        placed[key] = (min(way), 0) if up else (way[-1], len(way) - 1)
    members = defaultdict(list)
    for key, (root, depth) in placed.items():
        members[root].append((depth, key))
    position = {key: i + 1 for own_members in members.values() for i, (_, key) in enumerate(sorted(own_members))}
    return {key: (own[key], len(passages[key]), sum(to is not None for _, _, to in linked[key]), parent[key], *placed[key], position[key]) for key in own}


def mail(rng, conversations, turns):
    """Messages that quote earlier ones of their conversation, any of another one, or nobody, whole or in part, at one level or two."""
    rows, said = [], []
    for conv in range(conversations):
        for turn in range(turns):
            text = [f"{rng.choice(['Yes', 'No', 'Well'])} {conv} {turn}" if rng.random() < 0.8 else "Thanks"]
            if rng.random() < 0.4:
                text += ["", f"more of {rng.randrange(9)}", f"and {conv * turn}"]
            for _ in range(rng.randrange(3)):
                quoted = rng.choice(said)[3].split("\n") if said and rng.random() < 0.85 else [f"nobody {rng.random()}"]
                low = rng.randrange(len(quoted))
                quoted = quoted if rng.random() < 0.6 else quoted[low : low + 2]
                text = [("> " if q.startswith(">") or rng.random() < 0.95 else ">> ") + (q.upper() if rng.random() < 0.2 else q) for q in quoted] + text
                text = [*text, "then", *text[:1]] if rng.random() < 0.1 else text
            rows.append((conv, turn, "u", "\n".join(text)))
            said.append(rows[-1])
    ahead = rng.choice(said)
    rows[0] = (0, 0, "u", "> " + ahead[3].split("\n")[-1] + "\nfirst of all")
    return rows


def test_conversations_equal_brute_force(spark):
    links = 0
    for seed in (1, 2):
        rows = mail(random.Random(seed), 12, 9)
        wanted = brute(rows)
        for r in quotes.conversations(spark.createDataFrame(rows, MAIL).repartition(4)).collect():
            reply = (r.reply_conv, r.reply_turn) if r.reply_conv is not None else None
            assert (r.text, r.n_quotes, r.n_linked, reply, (r.root_conv, r.root_turn), r.depth, r.position) == wanted[r.conv_id, r.turn]
            links += reply is not None and reply[0] != r.conv_id
    assert links > 20


def test_parsing_is_linear_in_lines():
    rng = random.Random(3)
    for _ in range(200):
        text = "\n".join(rng.choice(["", "a", " b", ">", "> ", "> c", ">> d", "> > e", " > f", "  > g", "\t"]) for _ in range(rng.randrange(9)))
        assert quotes.runs(text) == split(text)
        assert [(r, i, quotes.Digests.of(t)) for r, i, t in parts(text)] == quotes.Digests().parts(text)
    began = time.process_time()
    found = quotes.parsed_message("\n".join(["> a", "b"] * 8000), quotes.Digests())
    assert time.process_time() - began < 2 and len(found[2]) == 8000
