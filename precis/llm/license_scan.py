"""Licence scans by canonical digest.

A text is brought to a canonical form in which layout, case, punctuation,
copyright lines and equivalent spellings make no difference, and the digest of
the entire form is looked up among the digests of known licences. Built-in
functions only; the known digests are a table of fixed size and are broadcast, so
a scan is one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import quoted

# Fixed values of the canonical form.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Quotes, dashes and other marks beyond ASCII that count as punctuation.
MARKS = "‘’‚‛“”„‟‐‑‒–—―…·•«»  "
#: A copyright line: the notice at its start, with a sign, a year or a placeholder.
COPYRIGHT_LINE = (r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]*[0-9<\[{]|©|all rights reserved)"
                  r"[^\n]*")
#: Words after "copyright" with which a line goes on in a licence sentence (a line may be broken before any word).
_SENTENCE = (r"notices?|holders?|owners?|ownership|laws?|licen[cs]e[sd]?|licensing|statements?|interests?|permissions?|"
             r"disclaimers?|treat(y|ies)|protections?|acts?|information|infringements?|claims?|works?|materials?|rights?|"
             r"grants?|doctrines?|like|legends?|and|or|in|on|if|is|are|was|were|as|to|for|of|under|that|which|it|may|"
             r"shall|will|the\s+(software|library|program|work|code|document|documentation|package|fonts?)")
#: A line that starts with the word and is no licence sentence, whatever follows.
ANY_COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*copyright[ \t:*_-]+(?!(" + _SENTENCE + r")\b)[a-z0-9\x{80}-\x{10ffff}][^\n]*"
#: Whatever is no ASCII letter or digit and not beyond ASCII.
SEPARATORS = r"[^a-z0-9\x{80}-\x{10ffff}]+"
#: Equivalent spellings, in canonical words (separators are single spaces by then).
SPELLINGS = (
    (" licence ", " license "), (" licences ", " licenses "), (" licenced ", " licensed "), (" licencing ", " licensing "),
    (" sub license ", " sublicense "), (" sub licence ", " sublicense "), (" non commercial ", " noncommercial "),
    (" non infringement ", " noninfringement "), (" copyright owner ", " copyright holder "),
    (" copyright owners ", " copyright holders "), (" favour ", " favor "), (" judgement ", " judgment "),
    (" acknowledgement ", " acknowledgment "), (" organisation ", " organization "), (" merchantibility ", " merchantability "),
    (" per cent ", " percent "), (" whilst ", " while "), (" wilful ", " willful "), (" https ", " http "),
)

#: SHA-256 digests of canonical licence texts.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Apache-2.0", "943bb73999aec94aa4b2f7a2278dcda1de8c61c618fce9e0d6aaef0344d2b5ec"),
    ("Apache-2.0", "97bb151359ca7824a239b0d881e1a58ad4d423d5b5c39e5c7b235fd47c1d52f7"),
    ("Apache-2.0", "9bd3d346fde9891f52e7dc4b8d8936c9e446536fd5eade45a50e39034a5530b4"),
    ("Apache-2.0", "dd6b373e28950376ea177a601b11ba7f0238e579d5802f43e69921c313c82549"),
    ("Apache-2.0", "e875a624b6d203a99f424efed1a6b4ecba44182ddb6e075bdc8e4bcd2bf5e637"),
    ("Apache-2.0", "fc9db7a0164e7200da89e02c3227560cc6bf5b50226261135c541f76ac8098f9"),
    ("Artistic-1.0-Perl", "005792a186ae0f9402339521d5dab41bfc27543fe405c681d272420976989ca9"),
    ("Artistic-1.0-Perl", "09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb"),
    ("Artistic-1.0-Perl", "a4ded8988ccbb4ad5cd1c456fb05c8c715750b157280d90781e42881f018301b"),
    ("Artistic-1.0-Perl", "aa26f40ff8bceaa224433a86c4cff90b769423f2e9a88832f8eeee317cdc07bd"),
    ("Artistic-1.0-Perl", "dce473218f071e33d95a6d9fd8eef04043176d3f4b0c2f3d22b96d545467bea7"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e"),
    ("CC0-1.0", "51598576b1cb0fadab71e4daa2de0d02bf1003e59c3b8bd9319040afe0310780"),
    ("CC0-1.0", "b10619f02618297e24138b898e618895ec9618110a119ed5235b09dc25dd5746"),
    ("CC0-1.0", "bb878d68e2bd11ce5ffb0510fa88413b5dfd6d8fe1de780da66de6f74cf984af"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("CC0-1.0", "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a"),
    ("GFDL-1.2", "2f1a0498221587b397469344ab897095ce242b0776f85e00678df78fd17b0053"),
    ("GFDL-1.2", "31d1e54824dc6954a36d4d6510f749ab693be943260bc59079362a26ad74ea17"),
    ("GFDL-1.2", "46df66eb30fadb738a42b19ccce2f18a583866e5837bccc790b4acff41ba12da"),
    ("GFDL-1.2", "774142f7f9d180b719ac1fe23dfba3589d91276d948e4dd116cb8811cec60691"),
    ("GFDL-1.2", "7b53826fb8825aa3994e10565ccb6d98a62ace1cc7827318c8b10672c0293275"),
    ("GFDL-1.2", "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"),
    ("GFDL-1.2", "893cfaa4ed374ccd5be70e589f7549e7225d4fab41f4ed2469dd04662ec3b7db"),
    ("GFDL-1.2", "8a9c8c19d0cf434c59961ec4de4ab7b409bd29c192e3f6d67e58d6cc4d871174"),
    ("GFDL-1.2", "904a794bbc7744b6d15eb14f31a82f0a63c030a6027c114c32137514dae116f4"),
    ("GFDL-1.2", "911acdf1929af65f8940939eae8eeabb39352742b2ed41f84bf883f4bace3555"),
    ("GFDL-1.2", "915561db8eb69b9193eeb710593d298365e0c52787feb731c684977d5b417af7"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.2", "a09a9415e4fdd9da7f2f8c67a4409e9db4021bdd1d76901f451932de9350766e"),
    ("GFDL-1.2", "a2c7d741d859fa142345a0453e6ad469b3dff00999c5d1e64ee7cdd51ff7df7d"),
    ("GFDL-1.2", "b87baa2747d68fbc956cef4f4be9e25f0f91d23a6f7c7fd47294c27147c26711"),
    ("GFDL-1.2", "bb893add3d24a414e0a92d05a8bb9175e4bf95c571ef7d75e90c171148d977f5"),
    ("GFDL-1.2", "cf77a218f7e648ebe9d44aff699b1056c915fd1eea45e7b689929ae0f252531d"),
    ("GFDL-1.2", "d445ab3336df310a32296d121e8ac7517fb258a8fb065fed8e1dbba0347b2973"),
    ("GFDL-1.2", "da4c85448f47d22603d951c573ac545a667904a5f6eab0104964d422566c7ed2"),
    ("GFDL-1.2", "f416312175fb5ff91a3e261e92c7c7bbb67fac12942bd339a60c8f95d1c6c974"),
    ("GFDL-1.2", "ff91799d3ddbe957e59799e0f6965cbe788e2145ddbc1a3f543abdeae3d67187"),
    ("GFDL-1.2", "ffeb18a1c7bfe6e0868297754b4d7da1fd282166ed5d1b796f7efb4473972e28"),
    ("GFDL-1.3", "092c28e0aeabbd2368456ee054468ce1c70d2183db70a5d19cf784ea703835ba"),
    ("GFDL-1.3", "0a544e14663c3f86687b0b1221daa784d4c9aea091a0f18111963b4985be5fa0"),
    ("GFDL-1.3", "1fdd53f1ef0ad288d6e9388b799ce36ae0484d524c9a2d2408a6f2f8e6dc5cef"),
    ("GFDL-1.3", "3c426fbfcdf22792d87bb85fe1538455be3c49904a6d4c0f754f86b16154c8bf"),
    ("GFDL-1.3", "3eac26c5e7268996bcf1d24538d488924c2ac51bcf0734500dfa91760793fc5d"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3", "b05b2bea1732c0cf884ed9806e715194592c433821b770f37f8ec58b6f5f14ea"),
    ("GFDL-1.3", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("GPL-1.0", "018aaaf7231e8a3c8e8a0800c7e593914a330040252f5dc554e1817d1a27f2d4"),
    ("GPL-1.0", "2360a1b8fc5b5a8b1db5f560a193fbbc23ee8a553de375a1c8fcc5805d683848"),
    ("GPL-1.0", "2ec1bd728dd10424f13890e12c27cca8a713a003952eee473fece8ff22798462"),
    ("GPL-1.0", "37a8d6ceffb74a4cd60be1028e4d7d9cc0b1682c4aa3c1d9efd628dc5460f60b"),
    ("GPL-1.0", "41020c05cfcb8b166bdf0c64e7f5f539feb5e7694933cf7d3bb79f6accd702b2"),
    ("GPL-1.0", "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12"),
    ("GPL-1.0", "4449b2a0b2da0e1097057c5b80004cb7dbf2c43a1cf47e127c2d92a274e4f944"),
    ("GPL-1.0", "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc"),
    ("GPL-1.0", "526a998a5f0ae9ed2e8c2dc03c12942fc9d724df13b0787dd3c80881d3688444"),
    ("GPL-1.0", "534c6ebf14c4c67a730174ff845b6dd8d84e88d8cb58a6d856feb8491b78ae8e"),
    ("GPL-1.0", "542eb44393b47446e7b5d9abb98b24262db09390d5986f0fb6feef9ead833086"),
    ("GPL-1.0", "5602e195886282e2e70886a9a6562b4421c5d89ade7051bb82f9ded288f1330e"),
    ("GPL-1.0", "587147d285760e8b32c65cfea99e50e171c906da73818509496f2b65efaf833e"),
    ("GPL-1.0", "5eba6902f4038a84a80879771855363939c7b81b83d57e7a776812d6d04c1b9b"),
    ("GPL-1.0", "5fcc149debc187a5439faada41342d88a9040d1fed00ca78f543889aa201bb79"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "6ca08526ee81355436001f14a8806abe1b624bd69c193bcb74e2abc8e629ade5"),
    ("GPL-1.0", "71fa4bd5fde166ce4fa896f8698e1bcf77024e8a262598b2ea4d3bcad7b6812f"),
    ("GPL-1.0", "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5"),
    ("GPL-1.0", "7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f"),
    ("GPL-1.0", "7c09aae3c270285817b370de14a701a9ba0c7d9b56b1c3a7be3b96e6ba5ed01f"),
    ("GPL-1.0", "858bb219a7a780439b4bc4b70a09728cb4a536c4609a75c282fdaf69c8a85201"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f3791039a137dc41a4222725079093e91fe98d5b92a8a4c0619e88addd253c6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d"),
    ("GPL-1.0", "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1"),
    ("GPL-1.0", "a87d2335c7c408f93c15dd6892a723a61b2645ff1ad65619233239cce6bd570d"),
    ("GPL-1.0", "a8a98615692e6d9738a3b77686ce468850d1e9a021d5434c1e1ce3af23286278"),
    ("GPL-1.0", "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697"),
    ("GPL-1.0", "b80c75f62f77e4b5c92f32edee9a5be7c924cc651474d90840fecc602674a983"),
    ("GPL-1.0", "c0734228e33375b72256fed50d8056b50049dff71f408765af98cd4384a7434a"),
    ("GPL-1.0", "cdbd45c61854c1e2790a3fbe3e5255711676eeb616f2cd64d0584130cfd4785c"),
    ("GPL-1.0", "d98bca1875592c382caba655043aec268528bc17c9d7c0a9e892b953378effa6"),
    ("GPL-1.0", "db97e230402c5d690524aaaae4e5ce0ff7d245046b571e57ebfb91b4e6cd263c"),
    ("GPL-1.0", "dc7236e1d58f9deece1952757bfb31b866953fdec9efb7d34c62a79b880d7392"),
    ("GPL-1.0", "de89607459486dd0bc99c017665c24034521654778db354ed72d202c8ad6a3b6"),
    ("GPL-1.0", "df6ee78d9635bf1a36c17a29168ac893caa0ca3e22c240a66bce6e666d9deb75"),
    ("GPL-1.0", "e60a000fbaef814103988b7923361d9a162470230b0603ec0922d6cc8564b736"),
    ("GPL-1.0", "ee41c15ce7d9cf5f29010590a0e4f4a6412fc1af33c10f280017db3f1fa0921b"),
    ("GPL-1.0", "efcbd5d5f621ec465277efcb03890a7fae6d9253e17b05ef7d7c6f90729a0fc9"),
    ("GPL-1.0", "f7f06bc0d0f810fba7577ea2a77c9a51df0f6d9db45c8d0d574a2902fda5d4cf"),
    ("GPL-2.0", "075bcb76902921614c275e6562daee18b3c9f48b9c4c92b8b99ba3df00093abb"),
    ("GPL-2.0", "07f9dc67ef43f8488ad21cd89644097f06a71dca46dd84f7c712db10702b0dea"),
    ("GPL-2.0", "1171588c40da9d76f3289dab10b04599a8488a8fbf4d716d6d29e239a5ff9aa7"),
    ("GPL-2.0", "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a"),
    ("GPL-2.0", "1d3015d0c95ac4c468939c7dc58e73a3f73a8592aa68d2af118ce60740773df7"),
    ("GPL-2.0", "2abe4f2f5ebff4aa8ed567a0cea0b9820cd074d9d7eda91d90df08701b51faa2"),
    ("GPL-2.0", "34cacbc5d4c8288f220e8dfade5276e6f76704f67150b4388c9ed3e3ff88cd90"),
    ("GPL-2.0", "37d5ffb67b9a128c3369e6bf2bb7b990ff212dcd086585e0319ff7ce55988d1f"),
    ("GPL-2.0", "3f6302b11b06e2ba13b2ac80ac77a1979662ab69ce0b459e03a0238dd35d3518"),
    ("GPL-2.0", "403ef646951799380f6649a9a9c05cad95d64f4003a8c7476b27b490acddcf33"),
    ("GPL-2.0", "464b45d65c9fb612f6ba2e2d21a6aacd7b621de2ef4db62d3a6c599c228fd982"),
    ("GPL-2.0", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3"),
    ("GPL-2.0", "5229c43236886a10e515744580348fa736d4f48fa284abefff6308056cba94ea"),
    ("GPL-2.0", "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd"),
    ("GPL-2.0", "5f3bcd48294d593b7647e36010d614bf45bfe3e5950aa6673782a092bbacc1af"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "6e18512edfd0364936194ced5792e417e972b66df15a6f0f3b2b7cd330ed4a3a"),
    ("GPL-2.0", "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25"),
    ("GPL-2.0", "8bce3c0010045bb9ea13c8025ec3c58d82fddf2d6f2f7a01d807e27da9edc024"),
    ("GPL-2.0", "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2"),
    ("GPL-2.0", "95aeb819f45bf6639f460cc0ba5fa250f81764324ef35320bf76fb9f99428fc1"),
    ("GPL-2.0", "97d5465462f2eceba0aa8f8ce38d8f9e7987e238f6fadb61dbe4f34b3a49029c"),
    ("GPL-2.0", "98e760555ff723908d803b23140ebd264fee15e7615bf9486faa0f8f6596c34f"),
    ("GPL-2.0", "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1"),
    ("GPL-2.0", "a96310c0126886e41d533f45005d1a2f38ac925a3bfaef1a8130b81d073307d0"),
    ("GPL-2.0", "aa75d54e4fbfdf0a9492e3f5d4ad1f93867a5fdd23c216c603d22461524ce1ce"),
    ("GPL-2.0", "ac164c60817349dc341fb503710f678c9f8afc5af87c7534931cf1bcd6e31e13"),
    ("GPL-2.0", "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c"),
    ("GPL-2.0", "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774"),
    ("GPL-2.0", "b1db576b0501c5696808df9f75d6c49f526e764a8f5a6dc589439bdd50b426b0"),
    ("GPL-2.0", "b34d24315532783b753a010af90dac63ca6a8ecba1af2e95dd624f978550c70c"),
    ("GPL-2.0", "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd"),
    ("GPL-2.0", "bfca6618ea38de65984d68db07b3047b7994b510ffff2cb850951e069529b8ef"),
    ("GPL-2.0", "cc5e906da6be25c1bd7043d43b6ae593952ed18b205716a7cd5c93213491d778"),
    ("GPL-2.0", "d111d1c24a44c987fb91de3ce5aab3ec35d8061a2c8a41ffaa8bb64c47df6960"),
    ("GPL-2.0", "e0deea08113c1a39c060c5733a436a3333e130ac4aecab400da2e0644b79f525"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "f1412332f5361d2a392bb637c3844ed3a32b7d701ac0e7abacce50b34a9a3afb"),
    ("GPL-2.0", "f285bc3733cac5b521b9507129b185a5f644847c954d9c5081d2405c9043b624"),
    ("GPL-3.0", "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19"),
    ("GPL-3.0", "575f9b4d2604d65745e0ec0a606c8c17cee519b7b41d71cff0f6bfeae47a2418"),
    ("GPL-3.0", "80d2bf43efa136ac2e7270ccf874f8bcfa290c73ed98846547ea57c88da9dc77"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "fad6d14122ae5943ea05f9e4d48194524a0b701f034fd22c7dded3e6c296c742"),
    ("LGPL-2.0", "07d2d80a87aec933ecf5a176fbea5e5427abb61db8822b2e934f6b861c5dc484"),
    ("LGPL-2.0", "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2"),
    ("LGPL-2.0", "09bda551cd6a1058f0e9053b4e2fcc0bfb193e8bb1e1485734c5113235b4a30d"),
    ("LGPL-2.0", "2652838d994cbfd49626674c95d3dd21f6f86da9dcd7b97e2a33347147ba5323"),
    ("LGPL-2.0", "346b4b56ee25a5058a9bafa545d3e568c301c5c396c60065e10508e82ad64cf7"),
    ("LGPL-2.0", "3c503e1843d56bee44590ba959b2a745cf954688aa5dd285043d139d8c3e6cd6"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "4401e0261a8caf4fd55eeb0e816fda06bbc9e4b2605767f5ffdf843a5c70e07e"),
    ("LGPL-2.0", "4ed7ee4d33f7dc376f7d218368e301b21dc31fee62f8d91352bf479d05a66ad1"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "505741d95d3788f067034a38bac6def1c65c4d1148aab305d192b08430412264"),
    ("LGPL-2.0", "542237188ef845a737d1eab5621ecfea8c3310f513f6ff72ad59d1d500e84b63"),
    ("LGPL-2.0", "5478d5a745a3ab1396a1d5db25a9869a5d318700fcf78f26f687effd8e10df4a"),
    ("LGPL-2.0", "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "61cbce1ad10d3b01d130a67aa9d339b8e0f260e773fe0383e51c1d9022ce9ede"),
    ("LGPL-2.0", "6de169d5260aa3ad51f6555d8351cf6e6cf02bf81e6bcf4a8d2b1a3f648bd7a3"),
    ("LGPL-2.0", "6e6982d8bb4468c5ce7a88e400f1540201513f39e8dd96e3607ee631b813c06f"),
    ("LGPL-2.0", "736aa88e50cf3c3ea93c80a3b9a349833dd1b381c6a9c336770f2c61822e164a"),
    ("LGPL-2.0", "737725713ce1bc043b456db251ef38d2e9a28a7033b47d1fc7b5a7eb47feb0d8"),
    ("LGPL-2.0", "73dbe68688642ea8753271a313d85ca880b4dc28379e1b21b2615f96758c5210"),
    ("LGPL-2.0", "7b963ffa655dbcc164b6f5a229407c98bdb620d97a461d25ea5f3f30cadf65cf"),
    ("LGPL-2.0", "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688"),
    ("LGPL-2.0", "936eb024285b788f0eddbf96826d70da1adefa3099b0ec5336ffe495c00b7798"),
    ("LGPL-2.0", "96c47047421b3be5cae9a68c75f37fdcf07945fba0a1d6db6a3b57f9c70f75a0"),
    ("LGPL-2.0", "a84e2cf380e92cbd1baf6ede7d939a2658de857b6ad1019fa0cb8f83dd494f86"),
    ("LGPL-2.0", "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c"),
    ("LGPL-2.0", "ad81fc738f377aeba41fc24738c2e644becc9d2b6dc33ae94d1d1b9c5658fdd8"),
    ("LGPL-2.0", "bdb969a377f6160f4ad0ed61171a77004650a9c2517d62828be29f35b6bf6b31"),
    ("LGPL-2.0", "cb25e5e1095347e992d553a6b90ba28c3eb94162214d5bcb01d79a61f270448e"),
    ("LGPL-2.0", "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318"),
    ("LGPL-2.0", "cd0909403712694c9ea18a84f7dbb5d566c041db3dbd0e334cd930c31dfea7df"),
    ("LGPL-2.0", "cfdb5c66c66bf96ca974b33dd3db756e6c7eb3329f999c38c122137bdb4be319"),
    ("LGPL-2.0", "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108"),
    ("LGPL-2.0", "d4689245f0c71022ce729821274153c787fdebe2e92f0de1f6d3c23326a5f619"),
    ("LGPL-2.0", "d8f786929d4cd5e353f34a8b5fff503ac6cad8e24ee35ceb9eea0d2298b7b4ef"),
    ("LGPL-2.0", "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1"),
    ("LGPL-2.0", "e3486a0000bbe009f718d654729c9fbce91815811f5429e302cbc6cf9f016320"),
    ("LGPL-2.0", "f0daec6a0f573603d63948a57e952939050886941e593ad62f992f20e0a12443"),
    ("LGPL-2.0", "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380"),
    ("LGPL-2.1", "081a6ecff0c8e50ab92b129954441c5d8fbc8f1f5a8987bf8d9225cde97aee2c"),
    ("LGPL-2.1", "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87"),
    ("LGPL-2.1", "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd"),
    ("LGPL-2.1", "19fc4e6af7a00c932e4783857ac9feb3df9eebbae0ad3d2e4d3addc5101b7c16"),
    ("LGPL-2.1", "1d2a09e288311515cd0682b55db758224412a4901ca0578bf16420229d5190c4"),
    ("LGPL-2.1", "20136473d72f8fa2c8e3998adda1cf5676c9bac2bb48f059ee804302841a5fb5"),
    ("LGPL-2.1", "2ef2859ae4577e1d4a14d215abfe8c8b9f6e4ba7dca97a8b81b6c205bf62d7ad"),
    ("LGPL-2.1", "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "48e731def9111ee21e7b6b5dca5cb8e908fe999f7c1ef9175afef1e4c8a5e26a"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "580d668437368921310389889745ec2a76860b0f634a684ce33c6a4e5d106957"),
    ("LGPL-2.1", "599d9303049b507aa89582ee08dd4ddaba298764648558e7bf8e78309807bfaa"),
    ("LGPL-2.1", "5c42345581e1857951a2f5c540eae7981a9540e2d41028f448a195bb48dd33f0"),
    ("LGPL-2.1", "5e1d84d9badba009fe8163dcbfb00a9606be2acd2a2ff04ac1ee700d18afb558"),
    ("LGPL-2.1", "62470f8c7f6c88c1c89d5e4080fc0969a43f31055e91336c089eb0ad2152027b"),
    ("LGPL-2.1", "63a9e54a9c20816b2c240f12cda2ee7d6c9f2bfb426b706197a99f75ada62c9a"),
    ("LGPL-2.1", "67cbe3d9cde32d4b753be7e7e3df91788805606d7a3d154914ca1673f19e9c33"),
    ("LGPL-2.1", "73ac55304afe4c219acdd0cb7683daf4fe3772c9b493da4a095d93a7789311d5"),
    ("LGPL-2.1", "77e5acffdb4b83d2e3ef8f1feb41cc7d5c859e0f7b2a31236b807ddc4248f9f5"),
    ("LGPL-2.1", "7cc1b31b95dd0bec1ff475bffceda6889681862c0b7d0da58cf97d3ae0a5d4bf"),
    ("LGPL-2.1", "7f73a17dcdb7946c6ea23e28fcbb0594b40082a3100afff1eb605337ec04bdf6"),
    ("LGPL-2.1", "91fba5fd5007350e2589cef732142c99ceaac0b15c8e36db486ec21766e5c803"),
    ("LGPL-2.1", "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb"),
    ("LGPL-2.1", "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4"),
    ("LGPL-2.1", "a410900e6983c792f42e2267911d7570e409cfb8af0c9125ef02a022229ab14d"),
    ("LGPL-2.1", "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47"),
    ("LGPL-2.1", "a6742add8db4ff9ba6917da0bd1f95927436acfd65ae81933f1e9a859d38d9fa"),
    ("LGPL-2.1", "ab682aaee683727453d8495c5d8feb7a103287c013c93d3318f1535e45d55aaf"),
    ("LGPL-2.1", "b11e56f26e36c27490673d8fa272b68666cfd474b64e23db5244d0ccde21fa9e"),
    ("LGPL-2.1", "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "c2469b247dd63f7768355282bc0c2542e37de1496ae64891d993a36802b4549b"),
    ("LGPL-2.1", "c9369494bc3c8d01995b30224c6aa0af52dd5fcb01230fbedb398a6d454a03bd"),
    ("LGPL-2.1", "d00d08192018b2217de04b223449941a18a7cb07d0c025393948065a12eb0fb2"),
    ("LGPL-2.1", "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421"),
    ("LGPL-2.1", "e8379077377b4f1cf6d306654dca012e99fec5e9a13474071c353ba3557fc48b"),
    ("LGPL-2.1", "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f"),
    ("LGPL-2.1", "f0b3313d45a8a467f987a040dc16addaea95621fdaededc28db994fccd572d0e"),
    ("LGPL-2.1", "fe1e4e79e75a761f9e18e6c55697cba51fe044489eb12d24fd4231b83ef47132"),
    ("LGPL-3.0", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("LGPL-3.0", "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "34386b9a926117ec1b973ef1b1ef8fba50be254811addc9f9659bcc5d5a096bf"),
    ("MPL-1.1", "4fbf4b1f3d8cf5d05e627fcb1b0dded60f72dbb2e5c2bc5bb929a8db71982f2d"),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("MPL-2.0", "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3"),
    ("MPL-2.0", "a3bf36aa02e067dc6790cedc69e2fd771e9e25252c0b8f126ddaa3ecad56ba8f"),
    ("MPL-2.0", "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3"),
    ("MPL-2.0", "e276f4f6100b514ae6fc211f3909a0583850ac58f32b35b3672ed07708616304"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER + MARKS, LOWER + " " * len(MARKS))


def canonical_text(text: Column, any_notice: bool = False) -> Column:
    """The canonical form of a licence text (null: empty). With ``any_notice`` every line
    that starts with "copyright" and is no licence sentence is a copyright line."""
    out = F.regexp_replace(_lowered(text), COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, ANY_COPYRIGHT_LINE, " ") if any_notice else out
    out = F.concat(F.lit(" "), F.regexp_replace(out, SEPARATORS, " "), F.lit(" "))
    for spelling, canonical in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(canonical))
    return F.trim(out)


def licence_digest(text: Column, any_notice: bool = False) -> Column:
    return F.sha2(canonical_text(text, any_notice), 256)


def freer_digest(text: Column) -> Column:
    """The digest without any copyright line; null where no line is one of the freer kind."""
    return F.when(_lowered(text).rlike(ANY_COPYRIGHT_LINE), licence_digest(text, any_notice=True))


def known_table(spark, digests=None) -> DataFrame:
    """(``_known``, ``license``) of known licences, one row per digest."""
    return spark.createDataFrame([(d, name) for name, d in digests or KNOWN_DIGESTS], "_known string, license string")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``digest`` of the canonical form of the whole
    text, and ``license`` (null if no known licence has that digest, nor the one
    of the text without any copyright line).

    ``known`` has (``_known``, ``license``) with one row per digest. A null text counts as empty and
    is no licence; null ids stay null; repeated rows stay repeated; other columns
    are not read; an empty table gives an empty result."""
    known = known_table(docs.sparkSession) if known is None else known
    rows = docs.select(quoted(id_col).alias("_id"), licence_digest(quoted(text_col)).alias("digest"),
                       freer_digest(quoted(text_col)).alias("_freer"))
    other = known.select(F.col("_known").alias("_known_freer"), F.col("license").alias("_license_freer"))
    rows = rows.join(F.broadcast(known), F.col("digest") == F.col("_known"), "left")
    rows = rows.join(F.broadcast(other), F.col("_freer") == F.col("_known_freer"), "left")
    return rows.select(F.col("_id").alias(id_col), "digest", F.coalesce("license", "_license_freer").alias("license"))
