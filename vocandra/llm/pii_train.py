"""Trains the tagger of problem 7: ``python -m vocandra.llm.pii_train FOLDER`` reads jobs and profiles of a test folder.

Labelled spans come from the grammars of ``pii`` in contexts that leave no doubt (given names next to family names,
well-formed numbers outside of codes and references). Names are often replaced by made-up ones, so that the tagger
learns their places and shapes instead of the list. Sentences with invented people, papers, numbers and streets of several
countries come on top (``invented``), alone or inside a text; their labels don't come from the grammars. Texts without
items train it on what is none.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np
import pandas as pd

from vocandra.llm import pii, tagger

STEPS, BATCH = 800, 96
_CODE = re.compile(r"(?:budget code|reference number|form|room|parcels|tickets|answers|req-?)\W*$", re.IGNORECASE)
_INITIAL = re.compile(rf"(?<=\s)[a-z]\. {pii._WORD}(?![\w@])", re.IGNORECASE)
#: Words after a given name that belong to the sentence.
_AFTER = set("will and or who the is was on at in for former assistant".split())
_FAMILY_END = re.compile(r"(?:well|mann|shaw|bridge|kov|eck|way|uchi|aldo|andra|quez|witz|wicz|stad|yan|ette|mire|by|moorthy|grave|ling)$", re.IGNORECASE)


def label(text: str) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []

    def put(s: int, e: int, kind: str) -> None:
        if not any(s < b and a < e for a, b, _ in spans):
            spans.append((s, e, kind))

    for kind in ("email", "identity", "address"):
        for m in pii.GRAMMAR[kind].finditer(text):
            code = kind == "identity" and _CODE.search(text[max(0, m.start() - 20) : m.start()])
            story = kind == "address" and re.search(r"\b(?:we|have|helped|of|the|in)\b", m.group(), re.IGNORECASE)
            if not code and not story:
                put(*m.span(), kind)
    for m in pii.PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if 9 <= digits <= 15 and not _CODE.search(text[max(0, m.start() - 20) : m.start()]):
            put(*m.span(), "phone")
    for initial, found in ((False, pii.named(text)), (True, _INITIAL.finditer(text))):
        for m in found:
            last = re.findall(pii._WORD, m.group())[-1]
            if last.lower() not in _AFTER and (not initial or _FAMILY_END.search(last)):
                put(*m.span(), "name")
    return sorted(spans)


def made_up(rng: random.Random, like: str) -> str:
    """Another name of the same form and case."""

    def word(m: re.Match) -> str:
        old = m.group()
        if len(old) < 2:
            return rng.choice("abcdefghijklmnoprstuvwz").upper() if old.isupper() else rng.choice("abcdefghijklmnoprstuvwz")
        new = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouaeio") for _ in range(rng.randint(1, 3))) + rng.choice(["n", "r", "s", "l", "ck", "well", "kov", "a", "is", "mann"])
        return new.upper() if old.isupper() else new.title() if old[0].isupper() else new

    return re.sub(r"[^\W\d_]+", word, like)


SYLLABLES = "ba be bo ca che da de do el fa fe ga go ha he in ja jo ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to u va ve vi wa we ya zo dré lé ño ß ö ü å ł ż".split()
SAID = {
    "name": ["{}", "Contact {}.", "Ask for {} at the desk.", "Your lead is Mr. {}", "Dr. {} signs it", "Hiring manager: {}", "written by {} in May", "{} will call back", "mrs {} answers mails", "Team lead {}, second floor"],
    "identity": ["SSN {}", "passport {}", "Passport no. {} is valid", "tax id {}", "licence {}", "ID card {}, issued here", "National number: {}", "{}"],
    "address": ["{}", "Office: {}", "Visit us at {}.", "{}, 2nd floor", "we moved to {} last year", "Address {}"],
    "phone": ["{}", "Call {}", "tel. {} after noon", "Mobile: {}", "WhatsApp {}."],
    "email": ["{}", "Write to {}", "mail: {} please", "Send it to {}."],
}
NOTHING = ["Machine Learning Engineer", "Product Manager, Growth Team", "Req 4471-22", "Room 12 at noon", "Version 3.11.2", "Build 20240112", "Monday to Friday", "New York Office", "12 way street rules", "9 to 5 culture", "Order 00412-7", "ISO 9001:2015", "Head of Data, Nordic Region"]


def invented(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence and its spans."""
    word = lambda n: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, n))).title()
    digits = lambda form: "".join(str(rng.randrange(10)) if c == "#" else rng.choice("ABCDEFGHJKLMNPRSTVXZ") if c == "@" else c for c in form)
    family = rng.choice([word(3), word(3), "O'" + word(2), "Mc" + word(2), "Mac" + word(2), f"{word(2)}-{word(2)}"])
    given = rng.choice([rng.choice(sorted(pii.GIVEN)).title(), word(2), word(3)])
    if rng.random() < 0.35:
        odd = word(3)
        own = [f"locations: {odd}, {word(3)}", f"because {odd} grows", f"next to {odd.lower()}.", f"About {odd} & {word(3)} Partners", f"our stack mixes {odd}, tests", f"{odd} and {word(2)} too.", f"From {odd}, we ship", f"the bell says {odd.lower()}", f"skills: {odd}, {word(2)}", f"Last checked {rng.randint(1, 28)}.{rng.randint(1, 28)}.2025"]
        return rng.choice([*NOTHING, *own]), []
    plain = f"{given} {family}"
    item = {
        "name": lambda: rng.choice([plain, plain, plain, plain, f"{family}, {given}", f"{given} {rng.choice('ABCDEKLMPRST')}. {family}", f"{given} {rng.choice('ABCDEKLMPRST')}. {family}", f"{given[0]}. {family}", f"{given[0]}. {family}"]),
        "identity": lambda: digits(rng.choice(["###-##-####", "@#######", "@@######", "#### #### ####", "@@ ## ## ## @", "@@-######-##/#", "@@@@@####@"])),
        "address": lambda: rng.choice([f"{rng.randint(1, 199)} {word(3)} {rng.choice('Street St Road Rd Avenue Lane Drive Court Square'.split())}", f"{word(2)}{rng.choice('straße strasse weg gasse platz allee'.split())} {rng.randint(1, 120)}", f"{rng.randint(1, 99)}, rue {word(3)}", f"{rng.randint(1, 99)} via {word(3)}", f"{rng.randint(1, 99)} calle {word(3)}"]),
        "phone": lambda: digits(rng.choice(["+## ### #######", "(0##) ####-####", "+#-###-###-####", "0## #### ####", "+## ## ## ## ##", "###.###.####"])),
        "email": lambda: f"{word(2)}.{word(2)}@{word(2)}.{rng.choice(['com', 'org', 'example', 'co.uk'])}".lower(),
    }
    kind = rng.choice(["name", "name", "name", "identity", "address", "phone", "email"])
    value, frame = item[kind](), rng.choice(SAID[kind])
    at = frame.index("{}")
    return frame.replace("{}", value), [(at, at + len(value), kind)]


def examples(texts: list[str], rng: random.Random):
    """(codes, gold) columns of one window each."""
    while True:
        text = rng.choice(texts)
        spans = label(text)
        if spans and rng.random() < 0.4:
            fresh, moved, at = "", [], 0
            for s, e, kind in spans:
                item = made_up(rng, text[s:e]) if kind == "name" and rng.random() < 0.7 else text[s:e]
                fresh += text[at:s]
                moved.append((len(fresh), len(fresh) + len(item), kind))
                fresh += item
                at = e
            text, spans = fresh + text[at:], moved
        if rng.random() < 0.35:
            added, inside = invented(rng)
            if rng.random() < 0.25 and len(added.lower()) == len(added):
                added = added.lower()
            if rng.random() < 0.4:
                text, spans = added, inside
            else:
                ends = [i for i, c in enumerate(text) if c == "\n" and not any(s < i < e for s, e, _ in spans)]
                at = rng.choice([0, len(text), *ends])
                added = "\n" + added + "\n"
                spans = [(s, e, k) if e <= at else (s + len(added), e + len(added), k) for s, e, k in spans] + [(at + 1 + s, at + 1 + e, k) for s, e, k in inside]
                text, spans = text[:at] + added + text[at:], sorted(spans)
        cased = rng.random()
        if cased < 0.2:
            other = text.upper() if cased < 0.13 else text.lower()
            text = other if len(other) == len(text) else text
        gold = np.zeros(len(text), np.int8)
        for s, e, kind in spans:
            k = tagger.KINDS.index(kind)
            gold[s] = 1 + 2 * k
            gold[s + 1 : e] = 2 + 2 * k
        parts = pii.stretches(text)
        if not parts and spans:  # items that no anchor marks train the tagger as well
            parts = [(max(0, spans[0][0] - 20), min(len(text), spans[0][1] + 20))]
        if not parts:
            continue
        if spans and rng.random() < 0.75:
            s = rng.choice(spans)[0]
            parts = [p for p in parts if p[0] <= s < p[1]] or parts
        a, b = rng.choice(parts)
        at = rng.choice(pii.windows(a, b))
        n = min(pii.WINDOW, b - at)
        if n <= 0:
            continue
        x, y = np.zeros(pii.WINDOW, np.int16), np.zeros(pii.WINDOW, np.int8)
        x[:n], y[:n] = tagger.encode(text[at : at + n]), gold[at : at + n]
        yield x, y


def main(folder: str, steps: int = STEPS, resume: int = 0, rate: float = 0.004) -> None:
    rng = random.Random(5)
    jobs = pd.read_parquet(f"{folder}/jobs.parquet", columns=["description"])["description"].dropna().tolist()
    rng.shuffle(jobs)
    jobs = jobs[:8000]
    profiles = pd.read_parquet(f"{folder}/candidate_profile.parquet", columns=["profile_json"])["profile_json"].tolist()
    strings = [f"{k}: {v}" for p in profiles for k, v in pii.profile_strings(p)]
    strings = [s for s in strings if label(s)] + [s for s in strings if not label(s)][:3000]
    jobs = [j for j in jobs if label(j)] + [j for j in jobs if pii.stretches(j) and not label(j)][:1500]
    texts = strings * (1 + len(jobs) // (2 * len(strings))) + jobs
    source = examples(texts, rng)

    def batches():
        for _ in range(steps):
            columns = [next(source) for _ in range(BATCH)]
            yield np.stack([c[0] for c in columns], 1), np.stack([c[1] for c in columns], 1)

    weights = pii.load_weights() if resume else tagger.init()

    def report(step: int, loss: float) -> None:
        print(step, round(loss, 3), flush=True)
        np.savez_compressed(pii.WEIGHTS, **{k: v.astype(np.float16) for k, v in weights.items()})

    tagger.train(weights, batches(), rate, report)


if __name__ == "__main__":
    main(*sys.argv[1:2], *map(int, sys.argv[2:4]), *map(float, sys.argv[4:5]))
