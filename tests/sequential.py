"""Record-at-a-time replays of the rules, as oracles for the transforms."""


def tumbling(ms, size):
    return [(ms - ms % size, ms - ms % size + size)]


def sliding(ms, size, slide):
    out, start = [], ms - ms % slide
    while start + size > ms:
        out.append((start, start + size))
        start -= slide
    return out


def replay_late(rows, assign, delay):
    """rows: event times in arrival order; gives (index, window, late)."""
    top, out = None, []
    for i, ms in enumerate(rows):
        top = ms if top is None else max(top, ms)
        for w in assign(ms):
            out.append((i, w, delay > 0 and w[1] < top - delay))
    return out


def replay_sessions(rows, gap):
    """rows: (key, time) in arrival order; gives {(key, number): [first seen.. count]} with one open session per key."""
    last, number, out = {}, {}, {}
    for key, t in rows:
        if key not in last or t - last[key] > gap:
            number[key] = number.get(key, 0) + 1
        last[key] = t
        out[key, number[key]] = out.get((key, number[key]), 0) + 1
    return out


def replay_ttl(rows, ttl):
    written, out = {}, []
    for key, t in sorted(rows, key=lambda x: x[1]):
        if key not in written or t > written[key] + ttl:
            written[key] = t
            out.append((key, t))
    return sorted(out)
