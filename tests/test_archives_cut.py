from tallyforge.operators import scan
from tallyforge.plans import fixtures


def test_a_cut_archive_is_unreadable_however_well_it_packs():
    pages = ["", "a", "<p>same</p>" * 500, "x" * 100_000, "".join(chr(33 + i * i % 90) for i in range(3000))]
    for html in pages:
        found = list(scan.expand("page-4", fixtures._pack(4, "", html)))
        assert [(n, p) for n, _, p in found if p] == [("page-4", "unreadable")] and len(found) == 2, html[:20]
    assert fixtures._pack(4, "", pages[4])[:2] == b"\x1f\x8b"
