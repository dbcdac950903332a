"""Plain step-by-step versions of the sequential rules, for small fixtures only."""

import random
import re

SPLIT = re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=[.?…-])\s")
VOCABULARY = ["so", "well", "end.", "really?", "hm…", "e.g.", "Dr.", "mid-", "yes,", "wow!", "U.S.", "ok."]


def random_words(seed, transcripts=4, n=60, steps_back=False):
    rng = random.Random(seed)
    rows = []
    for t in range(transcripts):
        speaker, at = 0, 0.0
        for pos in range(rng.randint(1, n)):
            if rng.random() < 0.3:
                speaker = rng.randint(0, 2)
            length = rng.choice([0.25, 0.5, 2.0, 4.0])
            rows.append((t, pos, speaker, at, at + length, rng.choice([0.25, 0.5, 0.75]), rng.choice(VOCABULARY)))
            at += length + rng.choice([0.0, 0.25, 3.0])
            if steps_back and rng.random() < 0.2:
                at -= 1.0
    return rows


WORDS = "transcript_id long, pos long, speaker int, start_s double, end_s double, speaker_confidence double, punctuated_word string"


def segments_of(words):
    """[(speaker, [word, ...]), ...] of one transcript's words."""
    out = []
    for w in words:
        if not out or out[-1][0] != w[2]:
            out.append((w[2], []))
        out[-1][1].append(w)
    return out


def sentences_of(segment):
    """Lists of words: the joined text is split, then words are dealt out by count."""
    speaker, words = segment
    left = list(words)
    out = []
    for text in SPLIT.split(" ".join(w[6] for w in words)):
        k = len(text.split())
        out.append(left[:k])
        left = left[k:]
    assert not left
    return out


def repair(segments):
    """segments: [(speaker, [sentence, ...])]; walk forward joining broken sentences, then merge."""
    todo = [[s, list(ss)] for s, ss in segments]
    done = [todo.pop(0)]
    while todo:
        cur, nxt = done[-1], todo[0]
        joined = False
        if cur[1]:
            a, b = cur[1][-1], nxt[1][0]
            if a[-1][6][-1] not in ".?,…" and abs(a[-1][5] - b[0][5]) > 0:
                joined = True
                if a[-1][4] - a[0][3] > b[-1][4] - b[0][3]:
                    cur[1][-1] = a + b
                    nxt[1].pop(0)
                else:
                    nxt[1][0] = a + b
                    cur[1].pop()
        if joined and not nxt[1]:
            todo.pop(0)
        else:
            done.append(todo.pop(0))
    merged = []
    for speaker, sentences in (d for d in done if d[1]):
        if merged and merged[-1][0] == speaker:
            merged[-1][1].extend(sentences)
        else:
            merged.append((speaker, list(sentences)))
    return merged


def snap(segments, chapters):
    out = []
    for no, at, title in chapters:
        for _, ss in segments:
            hit = next((s for s in ss if s[0][3] <= at <= s[-1][4]), None)
            if hit:
                lo, hi = hit[0][3], hit[-1][4]
                at = hi if at >= (lo + hi) / 2 else lo
                break
        out.append((no, at, title))
    return out


def clock(t):
    return f"{int(t // 3600):02d}:{int(t // 60 % 60):02d}:{int(t % 60):02d}"


def text_of(segments, chapters, per_line, single=False):
    out, due = [], list(chapters)
    for speaker, sentences in segments:
        stamp = (lambda t: "") if single else (lambda t, s=speaker: f"Speaker {s}: {clock(t)}\n\n")
        for i, s in enumerate(sentences):
            start = s[0][3]
            split_here = False
            if due and due[0][1] <= start:
                _, at, title = due.pop(0)
                if i:
                    out.append("\n" if per_line else "\n\n")
                out.append(f"## {title}\n\n")
                if i and not single:
                    out.append(stamp(at))
                    split_here = True
            if not i:
                out.append(stamp(start))
            body = " ".join(w[6] for w in s)
            if per_line:
                out.append(body + "\n")
            else:
                out.append(("" if not i or split_here else " ") + body + ("\n" if i == len(sentences) - 1 else ""))
        out.append("\n")
    return "".join(out).strip()


def paragraphs(segments, chapters):
    out, k = [], 0
    for speaker, sentences in segments:
        begin, title = sentences[0][0][3], None
        for s in sentences:
            if k < len(chapters) and chapters[k][1] <= s[0][3]:
                at = chapters[k][1]
                if begin < at:
                    out.append((begin, at, f"Speaker {speaker}", title))
                begin, title = at, chapters[k][2]
                k += 1
        ahead = k >= len(chapters) or begin < chapters[k][1]
        out.append((begin, sentences[-1][-1][4], f"Speaker {speaker}", title if ahead else None))
    return out


def cues(words, seconds):
    out, group = [], []
    for w in words:
        group.append(w)
        if w[4] - group[0][3] >= seconds:
            out.append(group)
            group = []
    return out + ([group] if group else [])


def pack(text, limit):
    if len(text) <= limit:
        return [text]
    out, cur = [], ""
    for p in text.split("\n\n"):
        if len(cur) + len(p) + 2 > limit:
            if cur:
                out.append(cur.strip())
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return out + ([cur.strip()] if cur else [])
