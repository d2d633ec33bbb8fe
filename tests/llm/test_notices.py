from runloom.llm import pages
from tests.llm.test_documents import PROSE, message

HEAP = "Tags: " + "; ".join(f"cheap-w{i}" for i in range(60)) + "; unsubscribe; disclaimer; " + "; ".join(f"deal-w{i}" for i in range(60))


def share(body):
    return pages.features(message(body))[0]


def test_heaps_with_a_word_of_notices_count():
    links = " ".join(f"word{i} - http://shop{i}.example/a{i}" for i in range(30)) + "\nunsubscribe - http://shop.example/u"
    assert share(PROSE + "\n\n" + HEAP) > 0.7 and share(PROSE + "\n\n" + links) > 0.7


def test_notices_are_still_left_out():
    short = "This mail is confidential. If you got it in error, please delete it."
    long = "The content of this mail is confidential and meant for the addressee alone. If it came to you by mistake, please tell the sender and delete it with all of its copies, as no one but the addressee may read or use it."
    for notice in (short, long, "unsubscribe | web version | imprint | contact"):
        assert pages.own_text(message(PROSE + "\n\n" + notice)) == pages.own_text(message(PROSE))
