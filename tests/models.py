"""The hard operators again in plain Python, as loops over small lists."""

from __future__ import annotations

DAY = 86_400_000_000


def nearest(lefts, rights, tolerance=None):
    """lefts: {id: (key, us)}; rights: [(key, us, value)] -> {id: (us, value) or None}."""
    found = {}
    for i, (key, us) in lefts.items():
        best = None
        for k, r_us, value in rights:
            if k != key:
                continue
            rank = (abs(us - r_us), r_us, value)
            if (tolerance is None or rank[0] <= tolerance) and (best is None or rank < best):
                best = rank
        found[i] = best and (best[1], best[2])
    return found


def points(drug, dose):
    if drug == "dopamine" and dose is not None:
        return 4 if dose > 15 else 3 if dose > 5 else 2
    if drug in ("epinephrine", "norepinephrine"):
        return 4 if dose is not None and dose > 0.1 else 3
    return 2


def window_scores(events, start, end):
    """events: [(us, organ, score, value, drug, dose)] of one account -> {organ: (score, us)}."""
    organs = {}
    for us, organ, score, value, _, _ in sorted(events, key=lambda e: e[0]):
        if organ in ("cardiovascular", "vasopressor") or not start <= us <= end:
            continue
        if organ not in organs or score > organs[organ][0]:
            organs[organ] = (score, us)
    best = (0, None)
    for us, organ, score, *_ in sorted(events, key=lambda e: e[0]):
        if organ == "cardiovascular" and start <= us <= end and score > best[0]:
            best = (score, us)
    drugs = {}
    for us, organ, _, _, drug, dose in sorted(events, key=lambda e: e[0]):
        if organ != "vasopressor" or not start <= us <= end:
            continue
        if drug not in drugs:
            drugs[drug] = (dose, us)
        elif dose is not None and (drugs[drug][0] is None or dose > drugs[drug][0]):
            drugs[drug] = (dose, us)
    for drug, (dose, us) in drugs.items():
        if points(drug, dose) > best[0]:
            best = (points(drug, dose), us)
    if best[0] > 0:
        organs["cardiovascular"] = best
    return organs


def best_window(events):
    best = None
    for us in sorted({e[0] for e in events}):
        organs = window_scores(events, us, us + DAY)
        total = sum(s for s, _ in organs.values())
        if best is None or total > best[0]:
            best = (total, us, organs)
    return best


def denial_start(pages, payors, phrases, header_lines=None):
    headers = ["\n".join(p.split("\n")[:header_lines]).lower() for p in pages]
    for i, h in enumerate(headers):
        if i:
            for pattern, name in payors:
                if pattern in h:
                    return i + 1, name
    for i, h in enumerate(headers):
        if i and any(p in h for p in phrases):
            return i + 1, "Unknown"
    return len(pages) + 1, "Unknown"
