from siftwell import options as O


def test_languages():
    assert O.rebuild_required("en", "ja") and O.rebuild_required("JA", None) and not O.rebuild_required("ja", "ko") and not O.rebuild_required("en", "xx")
    assert O.language("xx") is O.language("en") and O.language("ZH-Hant").bigrams and not O.language("ja").stopwords
    assert O.language("ko").letters == tuple("ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ") and len(O.language("en").letters) == 26 and not O.language("zh").letters


def test_options():
    got = O.read_options([None, "# doc_dir = /no\nDOC_DIR = /a=b\nwork_dir =\nlang = KO\nnoise", "doc_dir = /later"], {"SIFTWELL_WORK_DIR": "/w", "SIFTWELL_LANG": ""})
    assert got == O.Options("/a=b", "/w", "ko")
    assert O.read_options([], {"SIFTWELL_LANG": "xx"}) == O.Options()
    many = O.Options("/m", extra_dirs=("/z", "/b", "/m"))
    assert many.roots() == ["/m", "/b", "/z"] and many.roots("/only") == ["/only"] and O.Options().roots() == []
