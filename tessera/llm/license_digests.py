"""Canonical digests of long licence texts, with and without title and appendix.

Taken from the copies that Debian (common-licenses) and the Rust distribution ship, by the
canonical form of ``license_scan``; a text alone does not say "or later", so the identifiers
are those of the version itself.
"""

#: Identifier and SHA-256 of the canonical text.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "3db866cd4afc311800cde0e09874e0409a5184944a287bb1d3e321e7b5e84b6b"),
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", "c876a853e3837603a39d56da29306b74786b34411bf636ce5072eb840e764cab"),
    ("Apache-2.0", "d8221a4f10c01c6fa5390685929a5ce31d7264a024162fd3dd4d805c57ce0f43"),
    ("GPL-1.0-only", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-1.0-only", "211dc185b8d5f0975bb550f85f7069604f5b20ef981c39be760d643a14b2035b"),
    ("GPL-1.0-only", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-1.0-only", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-1.0-only", "fe1873252d8745083e66d80464d2da16717163bb0602dbf3cb3feb012890731d"),
    ("GPL-1.0-only", "839ed6871e0cf12ec5e9569c63feec3582da283bd67a626fc8f1489019021776"),
    ("GPL-2.0-only", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0-only", "8b9838a64c6503f24061766299cdd2a18f5eb01f27366294d3d6660b3ebff7e9"),
    ("GPL-2.0-only", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-2.0-only", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-2.0-only", "1a6314df2f1b575a5d85b1f2449d90edf9085f748178b506230a46a4ff5075d2"),
    ("GPL-2.0-only", "69da3f4eabbfbe9eee5464483b20baed123a4b12624331097a4428c49e2eb621"),
    ("GPL-2.0-only", "4727d78b5ad02fa15169ba8c7c27fbe69d5180e9d08aa9e2b6cf6f99b3eb97de"),
    ("GPL-2.0-only", "6aeaddd6c3f7a5b3efe76b3205498d7af5aa6ce4b20d84439a025b8818ac71e7"),
    ("GPL-2.0-only", "170a20f822f4b6582bc5aa7fb89056a62ff92891161df3b323edb8d6f3c753e9"),
    ("GPL-2.0-only", "4005f8f040a757bea42817c94ba8b813517beb0cae30a5eb43ae82e76d91a81a"),
    ("GPL-2.0-only", "a2986b9406cbc4bc44dad4e0509d66e0d83d6098971ccf8fc25912d2728c5b87"),
    ("GPL-2.0-only", "51e971d55d41e9bba73e28d4a48a56d56d9840a792c848d1f70ac57106222020"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0-only", "575f9b4d2604d65745e0ec0a606c8c17cee519b7b41d71cff0f6bfeae47a2418"),
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0-only", "80d2bf43efa136ac2e7270ccf874f8bcfa290c73ed98846547ea57c88da9dc77"),
    ("GPL-3.0-only", "fad6d14122ae5943ea05f9e4d48194524a0b701f034fd22c7dded3e6c296c742"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", "7b963ffa655dbcc164b6f5a229407c98bdb620d97a461d25ea5f3f30cadf65cf"),
    ("LGPL-2.0-only", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0-only", "5478d5a745a3ab1396a1d5db25a9869a5d318700fcf78f26f687effd8e10df4a"),
    ("LGPL-2.0-only", "d4689245f0c71022ce729821274153c787fdebe2e92f0de1f6d3c23326a5f619"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-only", "91fba5fd5007350e2589cef732142c99ceaac0b15c8e36db486ec21766e5c803"),
    ("LGPL-2.1-only", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1-only", "2ef2859ae4577e1d4a14d215abfe8c8b9f6e4ba7dca97a8b81b6c205bf62d7ad"),
    ("LGPL-2.1-only", "73ac55304afe4c219acdd0cb7683daf4fe3772c9b493da4a095d93a7789311d5"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0-only", "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-1.1", "34386b9a926117ec1b973ef1b1ef8fba50be254811addc9f9659bcc5d5a096bf"),
    ("MPL-1.1", "dc35ab5d2f724b3a08915b5fd7b64317f8dc3c46046392b1e5c2e0239eaa8b7a"),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"),
    ("MPL-1.1", "024dde6e13c90edeacef5546f7f8ea32762fdb3918eb98f24808d7eba8333000"),
    ("MPL-1.1", "4fbf4b1f3d8cf5d05e627fcb1b0dded60f72dbb2e5c2bc5bb929a8db71982f2d"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("MPL-2.0", "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC0-1.0", "4f8ab63ace774f37529081c81e2730a88143bf70e67392bd3c3701bd0a175152"),
    ("CC-BY-SA-4.0", "4dd2d8faa991a43111f73718974d1a9133ba1453cd76d174da75d163e35fa974"),
    ("CC-BY-SA-4.0", "8ebbc181939a1fd54b34489f672adfd2862b562c8facb0753600517daa3bde57"),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.2-only", "904a794bbc7744b6d15eb14f31a82f0a63c030a6027c114c32137514dae116f4"),
    ("GFDL-1.2-only", "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"),
    ("GFDL-1.2-only", "da4c85448f47d22603d951c573ac545a667904a5f6eab0104964d422566c7ed2"),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3-only", "3eac26c5e7268996bcf1d24538d488924c2ac51bcf0734500dfa91760793fc5d"),
    ("GFDL-1.3-only", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("GFDL-1.3-only", "1fdd53f1ef0ad288d6e9388b799ce36ae0484d524c9a2d2408a6f2f8e6dc5cef"),
]
