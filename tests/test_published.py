"""Containers of the values below 10**12 against published sizes and hashes; about a minute."""

import hashlib

import pytest

from primeweave.functions.primes import carmichael_below
from primeweave.operators.divisors import least_valid
from primeweave.sources import formats, pwt2

#: Bytes and SHA-256 of each file.
PUBLISHED = {
    "text": (249924, "df648163ece972c23aea5e2a773e3523bb9762729c609205a0e1df7f9166b7c7"),
    "orc1": (65489, "631569c253dda47882649f067f2bb3e5785dab4663b0c62121bdadc3f442003e"),
    "n.raw": (131856, "04cb6542ace1c2bccb219298cda8feceddab3c98d47c025e83047b3c7373107d"),
    "d.raw": (131856, "169243a85639adf3c66dd5205d451e64ad13d3b548582c5386708cc50f62cff7"),
    "d paths": (494460, "42773c997da5df03141faba8189795d9bce5ecccc4f10e311e77e2c461f8577e"),
    "full paths": (576870, "916af1916f5b18466447d3f55b47af779b1149aaceeb8c5cb5bf2beed6e7c656"),
    "n gaps": (33207, "473107cf58750525fdddc7817b48f476120607369162a81a8cb4ee4b8951f766"),
    "d gaps": (17634, "92f3e2262565f8a5be46dc5a2e4ca49c19865b82440d85ac0464bebccc24a0db"),
    "n classes": (10840279, "0191b99475eb3b9bc6fbe8a2961651f752eaa21a9b39fc86c8d4d1649a7c0ac8"),
    "d classes": (17315, "db39632180be73e52898e01ff1a1483686a3fd195d46010f301ecdaa08d5cd9b"),
    "full tree, bytes": (50196, "20c78b35afa23881990e9476ef48a0781ae3bdc8c371115c7413cdf2d9bf1e4b"),
    "full tree, set 3": (65539, "26d8ee0f99fb739a19b0d3ca5287912d7e55aea9f5b6c2da5ec3fcf3fd1c308c"),
    "d tree, bytes": (27440, "b5edad88cb8f0784cdc22302bddf4e2ff2b3defdf6e360a0d86cdb0932fc25f2"),
    "d tree, set 3": (38132, "c1c672c0c3f9c83920fc86ffd8eab432c342c3cdc4462cef0a50d5f1c134dc75"),
    "full tree's paths": (576870, "da690f7afe59f12aef4e95e4b7030b1dd1072eedca57e6d37f478e53a374f4fe"),
    "d tree's paths": (494460, "fe2f5ce208763ff24b227398476061f19298cb47c9e886a4e57204a010458fb1"),
}


@pytest.fixture(scope="module")
def files():
    table = carmichael_below(10**12)
    n, full = [n for n, _ in table], [f for _, f in table]
    chosen = [least_valid(*r)[0] for r in table]
    paths = [[p for p in f if d % p == 0] for d, f in zip(chosen, full, strict=True)]
    d, t = sorted(chosen), formats.targets(n)
    trees = {name: pwt2.encode(p, t, p is full, kind) for name, p, kind in (("full tree, bytes", full, None), ("full tree, set 3", full, 3), ("d tree, bytes", paths, None), ("d tree, set 3", paths, 3))}
    return trees | {
        "text": "".join(formats.text_line(*r) for r in table).encode(),
        "orc1": formats.orc1_encode(table),
        "n.raw": formats.raw16(n),
        "d.raw": formats.raw16(d),
        "d paths": b"".join(formats.path_record(p, 12) for p in paths),
        "full paths": b"".join(formats.path_record(p, 14) for p in full),
        "n gaps": formats.vbg1_encode(n),
        "d gaps": formats.vbg1_encode(d),
        "n classes": formats.cnd_encode(n, 10810800, t),
        "d classes": formats.cnd_encode(d, 2310, t),
        "full tree's paths": b"".join(formats.path_record(p, 14) for p in pwt2.decode(trees["full tree, set 3"])),
        "d tree's paths": b"".join(formats.path_record(p, 12) for p in pwt2.decode(trees["d tree, set 3"])),
    }


@pytest.mark.parametrize("name", PUBLISHED)
def test_published(files, name):
    assert (len(files[name]), hashlib.sha256(files[name]).hexdigest()) == PUBLISHED[name]
