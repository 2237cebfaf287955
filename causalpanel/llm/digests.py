"""SQL for the digests that DuckDB has no function for: CRC-32 and XXH64."""

from __future__ import annotations

from functools import reduce

#: CRC-32 four bits at a time: what each of the 16 values of the low bits turns into.
CRC_STEPS = [reduce(lambda a, _: a >> 1 ^ 0xEDB88320 * (a & 1), range(4), value) for value in range(16)]
#: The fixed primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def xxh64_sql(source: str, seed: int = 42) -> str:
    """SQL tables that end in ``hashed``: s, h (XXH64 of its UTF-8 bytes) of the texts s of ``source``."""
    whole = (1 << 64) - 1
    cut_off = lambda x: f"(({x}) & {whole}::uhugeint)::ubigint"
    times = lambda x, p: cut_off(f"({x})::uhugeint * {p}::uhugeint")
    plus = lambda x, y: cut_off(f"({x})::uhugeint + ({y})::uhugeint")
    turned = lambda x, r: f"(((({x}) & {whole >> r}::ubigint) << {r}) | (({x}) >> {64 - r}))"
    lane = lambda at, width: f"('0x' || substr(back, (2 * (n - ({at}) - {width}) + 1)::bigint, {2 * width}))::ubigint"
    mixed = lambda acc, x: times(turned(plus(acc, times(x, P2)), 31), P1)
    starts = ", ".join(f"{v & whole}::ubigint" for v in (seed + P1 + P2, seed + P2, seed, seed - P1))
    stripe = ", ".join(lane(f"32 * j + {8 * q}", 8) for q in range(4))
    total = " + ".join(turned(f"acc[{q + 1}]", r) + "::uhugeint" for q, r in enumerate((1, 7, 12, 18)))
    zero = "0::ubigint"
    steps = [f"case when stripes > 0 then {cut_off(total)} else {seed + P5}::ubigint end"]
    steps += [f"case when stripes > 0 then {plus(times(f'xor(h, {mixed(zero, f"acc[{q}]")})', P1), P4)} else h end" for q in range(1, 5)]
    steps += [plus("h", "n")]
    for q in range(3):
        word = mixed(zero, lane(f"32 * stripes + {8 * q}", 8))
        steps += [f"case when n % 32 // 8 > {q} then xor(h, {word}) else h end", f"case when n % 32 // 8 > {q} then {plus(times(turned('h', 27), P1), P4)} else h end"]
    steps += [f"case when n % 8 >= 4 then xor(h, {times(lane('n // 8 * 8', 4), P1)}) else h end", f"case when n % 8 >= 4 then {plus(times(turned('h', 23), P2), P3)} else h end"]
    for q in range(3):
        steps += [f"case when n % 4 > {q} then xor(h, {times(lane(f'n // 4 * 4 + {q}', 1), P5)}) else h end", f"case when n % 4 > {q} then {times(turned('h', 11), P1)} else h end"]
    steps += [times("xor(h, h >> 33)", P2), times("xor(h, h >> 29)", P3), "xor(h, h >> 32)"]
    tables = [
        f"texts as (select s, encode(s) as bytes from (select distinct s from {source}))",
        "sized as (select s, octet_length(bytes) as n, octet_length(bytes) // 32 as stripes, array_to_string(list_reverse(regexp_extract_all(hex(bytes), '..')), '') as back from texts)",
        f"""z as (
  select *, list_reduce(list_concat([[{starts}]], [[{stripe}] for j in range(stripes)]),
                        lambda acc, x: [{', '.join(mixed(f'acc[{q}]', f'x[{q}]') for q in range(1, 5))}]) as acc from sized)""",
    ]
    before = "z"
    for k, step in enumerate(steps):
        tables.append(f"z{k} as (select * {'' if not k else 'replace '}{'(' if k else ', '}{step} as h{')' if k else ''} from {before})")
        before = f"z{k}"
    return ",\n".join([*tables, f"hashed as (select s, h from {before})"])


def crc32_sql(source: str) -> str:
    """SQL tables that end in ``summed``: all columns of ``source`` and crc (CRC-32 of its UTF-8 ``text``, null as empty)."""
    return f"""bytes as (select *, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as pairs from {source}),
digits as (
  select *, list_concat([4294967295::bigint], flatten([[('0x' || b[2])::bigint, ('0x' || b[1])::bigint] for b in pairs])) as halves from bytes),
summed as (
  select * exclude (pairs, halves),
         xor(4294967295, list_reduce(halves, lambda crc, x: xor(crc >> 4, {CRC_STEPS}[(xor(crc, x) & 15) + 1])))::bigint as crc from digits)"""
