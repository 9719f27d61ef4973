"""Examples of a dataset, prompt by prompt, against plain Python."""

from __future__ import annotations

import datetime as dt
import json
import random

from parlance.operators import artifacts as ar
from parlance.operators import dataset as ds
from parlance.plans.durable import fresh_path

T0 = dt.datetime(2024, 1, 1)
MENTION = "array<struct<person_id:string,start:int,length:int,name:string>>"
MESSAGES = f"message_id string, chat_id string, author_id string, sent_at timestamp, edited_at timestamp, deleted_at timestamp, text string, quote struct<reply_to:string,author_id:string,sent_at:timestamp,text:string,mentions:{MENTION}>, attachments array<struct<id:string,media_type:string,name:string,size:bigint>>, mentions {MENTION}"
REACTIONS = "event_id string, message_id string, chat_id string, author_id string, value string, sent_at timestamp, removed boolean"
TARGET, NAME, K = "p-t", "Tess", 4


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def corpus(seed=11, n=90):
    """Messages of four people in two chats, some edited, deleted, with attachments, mentions and quotes, and reactions."""
    rng = random.Random(seed)
    messages, reactions = [], []
    for i in range(n):
        sent, author = rng.randrange(200), rng.choice([TARGET, TARGET, "p-a", "p-b", "p-c"])
        mentions, text = [], rng.choice([None, f"text {i}", f'say "{i}" ü', "  "])
        if rng.random() < 0.3:
            text, mentions = f"￼ and ￼ {i}", [(rng.choice([TARGET, "p-a", "p-z"]), s, 1, None) for s in rng.sample([0, 6], rng.randrange(1, 3))]
        quote = None
        if i > 5 and rng.random() < 0.4:
            m = messages[rng.randrange(i)]
            said = rng.choice([None, "￼ was", "said"])
            quote = (rng.choice([m["message_id"], "gone"]), rng.choice([None, m["author_id"], "p-q"]), at(m["sent"]), said, [("p-b", 0, 1, None)] if said == "￼ was" else [])
        files = [("f", None, None, None)] * (rng.random() < 0.25) * rng.randrange(1, 3)
        messages.append({"message_id": f"m{i:03}", "chat_id": rng.choice("xy"), "author_id": author, "sent": sent, "edited": sent + rng.choice([3, 50]) if rng.random() < 0.15 else None, "deleted": sent + rng.choice([3, 50]) if rng.random() < 0.15 else None, "text": text, "quote": quote, "files": files, "mentions": mentions})
    for j in range(60):
        m = rng.choice(messages)
        reactions.append((f"r{j:02}", m["message_id"], m["chat_id"], rng.choice([TARGET, "p-a", "p-r"]), "👍", m["sent"] + rng.randrange(60), rng.random() < 0.3))
    return messages, reactions


def brute(messages, reactions, valid=0.2, test=0.2):
    people = {m["author_id"] for m in messages} | {x[0] for m in messages for x in m["mentions"]} | {r[3] for r in reactions}
    people |= {m["quote"][1] for m in messages if m["quote"] and m["quote"][1]} | {x[0] for m in messages if m["quote"] for x in m["quote"][4]}
    names = {p: f"person_{i:02}" for i, p in enumerate(sorted(people - {TARGET}), 1)} | {TARGET: NAME}

    def shown(text, mentions):
        for who, start, length, _ in sorted(mentions, key=lambda x: -x[1]):
            text = text[:start] + "@" + names[who] + text[start + length :]
        return text

    def reply(m, context):
        if not m["quote"]:
            return None
        to, who, _, text, mentions = m["quote"]
        original = next((c for c in context if c["message_id"] == to), None)
        author = names[who] if who else names[original["author_id"]] if original else None
        said = shown(text, mentions) if text is not None else shown(original["text"], original["mentions"]) if original and original["text"] is not None else None
        whom = f"reply to {author}" if author else "reply to an earlier message"
        return whom if said is None else f"{whom}: {json.dumps(said, ensure_ascii=False)}"

    def entry(m, context):
        n = len(m["files"])
        parts = [names[m["author_id"]], f"mentions @{NAME}" if any(x[0] == TARGET for x in m["mentions"]) else None, f"{n} attachment{'s' * (n > 1)}" if n and m["text"] is not None else None, reply(m, context)]
        body = "[deleted message]" if m["deleted"] is not None else shown(m["text"], m["mentions"]) if m["text"] is not None else "[attachment]" if n else "[empty message]"
        return f"\n[{' | '.join(p for p in parts if p)}]\n{body}"

    mine = [m for m in messages if m["author_id"] == TARGET and m["deleted"] is None and m["edited"] is None and not m["files"] and m["text"] is not None and (m["text"].replace("￼", "").strip() or m["mentions"])]
    mine.sort(key=lambda m: (m["sent"], m["message_id"]))
    n, v, t = len(mine), max(1, int(len(mine) * valid)), max(1, int(len(mine) * test))
    out = {}
    for split, part, before in (("train", mine[: n - v - t], None), ("valid", mine[n - v - t : n - t], mine[n - v - t - 1]), ("test", mine[n - t :], mine[n - t - 1])):
        for index, m in enumerate(part):
            seen = [c for c in messages if c["chat_id"] == m["chat_id"] and max(x for x in (c["sent"], c["edited"], c["deleted"]) if x is not None) < m["sent"] and (before is None or (c["sent"], c["message_id"]) > (before["sent"], before["message_id"]))]
            context = sorted(seen, key=lambda c: (c["sent"], c["message_id"]))[-K:]
            ids = {c["message_id"]: c for c in context}
            lines = [(c["sent"], 0, c["message_id"], entry(c, context)) for c in context]
            for e, to, _, who, value, when, removed in reactions:
                if to in ids and when < m["sent"]:
                    subject = names[ids[to]["author_id"]] + "'s message"
                    line = f"{names[who]} removed {json.dumps(value, ensure_ascii=False)} reaction from {subject}" if removed else f"{names[who]} reacted {json.dumps(value, ensure_ascii=False)} to {subject}"
                    lines.append((when, 1, e, f"\n[{line}]"))
            lines.sort(key=lambda x: x[:3])
            said = reply(m, context)
            prompt = "\n".join([f"You are {NAME}. Write only {NAME}'s next message.", "\nConversation:", "\n".join(x[3] for x in lines), f"\n[{' | '.join(['next response'] + ([said] if said else []))}]"])
            out[split, index] = (m["message_id"], [x[2] for x in lines if x[1] == 0], [x[2] for x in lines if x[1] == 1], prompt, shown(m["text"], m["mentions"]))
    return out


def frames(spark, messages, reactions):
    rows = [(m["message_id"], m["chat_id"], m["author_id"], at(m["sent"]), at(m["edited"]), at(m["deleted"]), m["text"], m["quote"], m["files"], m["mentions"]) for m in messages]
    return spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([(*r[:5], at(r[5]), r[6]) for r in reactions], REACTIONS)


def test_examples_against_plain_python(spark):
    messages, reactions = corpus()
    m, r = frames(spark, messages, reactions)
    recipe = ds.Recipe(TARGET, NAME, K, 0.2, 0.2)
    got = {(x["split"], x["index"]): (x["target_message_id"], x["context_message_ids"], x["context_reaction_event_ids"], x["prompt"], x["completion"]) for x in ds.examples(m, r, recipe).collect()}
    want = brute(messages, reactions)
    assert got.keys() == want.keys() and len(want) > 10
    for key in want:
        assert got[key] == want[key], key


def test_build_is_what_examples_say(spark):
    """One id for the same messages; rows of the parts in the order of the index; another recipe is another dataset."""
    messages, reactions = corpus()
    m, r = frames(spark, messages, reactions)
    want, root = brute(messages, reactions), fresh_path(spark, "data")
    one = ds.build(spark, m, r, ds.Recipe(TARGET, NAME, K, 0.2, 0.2), root)
    manifest = ar.verify_artifact(spark, f"{root}/{one}")
    for split in ("train", "valid", "test"):
        rows = ar.read_part(spark, f"{root}/{one}", f"{split}.jsonl").orderBy("index").collect()
        assert [(x["index"], json.loads(x["value"])) for x in rows] == [(i, {"prompt": want[s, i][3], "completion": want[s, i][4]}) for s, i in sorted(want) if s == split]
        assert manifest["files"][f"{split}.jsonl"]["rows"] == len(rows)
    assert manifest["files"]["index.jsonl"]["rows"] == len(want)
    assert ds.build(spark, m, r, ds.Recipe(TARGET, NAME, K - 1, 0.2, 0.2), root) != one
