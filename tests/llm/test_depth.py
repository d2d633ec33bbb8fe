import base64

from runloom.llm import mail
from tests.llm.test_documents import message


def test_parts_below_any_level():
    inner = message(base64.b64encode("Grüße aus dem Hafen".encode()).decode(), encoding="base64")
    multi, mails = inner, inner
    for i in range(60):
        multi = f'Content-Type: multipart/mixed; boundary="b{i}"\n\n--b{i}\n{multi}\n--b{i}--\n'
        mails = f"Content-Type: message/rfc822\n\n{mails}"
    assert [t.strip() for t in mail.readable_texts(multi)] == [t.strip() for t in mail.readable_texts(mails)] == ["Grüße aus dem Hafen"]
