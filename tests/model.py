"""The expected results on small inputs, worked out row by row in plain Python."""

from collections import Counter, defaultdict


def key_of(line, delimiter, n):
    return delimiter.join(line.split(delimiter)[:n])


def keyed(files, delimiter=";", n=6, header=True):
    """``(file, line number, stripped line, key)`` of the rows that take part, files in name order."""
    found = []
    for name in sorted(files):
        for number, raw in enumerate(files[name]):
            line = raw.strip()
            if line and not (header and number == 0):
                found.append((name, number, line, key_of(line, delimiter, n)))
    return found


def fates(rows):
    """``(file, line number) -> fate``."""
    keep, out = {}, {}
    for name, number, _, key in sorted(rows, key=lambda r: r[:2]):
        first = keep.setdefault(key, (name, number))
        if first == (name, number):
            out[name, number] = "kept"
        else:
            out[name, number] = "within_deleted" if first[0] == name else "cross_deleted"
    return out


def entries(rows, prefix_len=47):
    """``(prefix, key, scope, total, file, count)`` of every duplicate key and file."""
    per_key, prefix = defaultdict(Counter), {}
    for name, _, line, key in sorted(rows, key=lambda r: r[:2]):
        per_key[key][name] += 1
        prefix.setdefault(key, line[:prefix_len])
    return {
        (prefix[key], key, "cross" if len(files) > 1 else "within", sum(files.values()), name, n)
        for key, files in per_key.items()
        if sum(files.values()) > 1
        for name, n in files.items()
    }


def report(found, item="    - ", within="(Within-file duplicates) "):
    by_key = defaultdict(list)
    for prefix, key, scope, _, name, _ in found:
        by_key[prefix, key, scope].append(name)
    lines = []
    for (prefix, _, scope), names in sorted(by_key.items()):
        lines.append(prefix)
        lines += [item + (within if scope == "within" else "") + name for name in sorted(names)]
    return lines


def cleaned(files, fate):
    """Lines of every file that stay: header, blanks and kept rows."""
    return {
        name: [raw for number, raw in enumerate(lines) if fate.get((name, number), "kept") == "kept"]
        for name, lines in files.items()
    }
