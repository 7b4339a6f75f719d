"""Digests of full licence files, in the forms of ``license_scan.full_forms``: fixed values, made from /usr/share/common-licenses."""

#: File, licence, and lines of its title.
FILES = (
    ("Apache-2.0", "Apache-2.0", 3),
    ("Artistic", "Artistic-1.0-Perl", 1),
    ("BSD", "BSD-3-Clause-UC", 0),
    ("CC0-1.0", "CC0-1.0", 2),
    ("GFDL-1.2", "GFDL-1.2", 2),
    ("GFDL-1.3", "GFDL-1.3", 2),
    ("GPL-1", "GPL-1.0", 2),
    ("GPL-2", "GPL-2.0", 2),
    ("GPL-3", "GPL-3.0", 2),
    ("LGPL-2", "LGPL-2.0", 2),
    ("LGPL-2.1", "LGPL-2.1", 2),
    ("LGPL-3", "LGPL-3.0", 2),
    ("MPL-1.1", "MPL-1.1", 3),
    ("MPL-2.0", "MPL-2.0", 2),
)

FULL_DIGESTS = (
    ("Apache-2.0", "622fc03e7533c5f35400f87ba05aef4aa91efa281c18741e99ef504cc8c78ad0"),
    ("Apache-2.0", "6f969f3bab5c7eb6e5e365b9f09eb433596a88a751fbd25767410c3bf49232fe"),
    ("Apache-2.0", "797dc3f7b075ef4c33e8e6f3218cc37a725c5d64cae02dcf7c47a46bff473a8b"),
    ("Apache-2.0", "b35b83acee1925f4ac31d46b381bc9d2c40dc1a05e2f34d5dabb988b86b42ab6"),
    ("Apache-2.0", "c1c0704caa0bece8e9cf965100efe6a1e373c1d95c51aa5a681849640719d9e7"),
    ("Apache-2.0", "d8221a4f10c01c6fa5390685929a5ce31d7264a024162fd3dd4d805c57ce0f43"),
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause-UC", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC0-1.0", "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32"),
    ("CC0-1.0", "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6"),
    ("GFDL-1.2", "16018093d4eae05ac163ded9a99e3cee0c34973aff5e3ed77adfc4da5f190986"),
    ("GFDL-1.2", "20e1fd3e8cb6a8d05d4182764f039c8478d886d77e4eb45c3847198e308bae8e"),
    ("GFDL-1.2", "3d6d424ae298aad62975c07d6d3c8ea398b2d302e6fda62e8f4137a53e894b39"),
    ("GFDL-1.2", "51bd3cfd98bb8526122c7ba3462630a59dd0b576681d71df4d8d3af3130e8868"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.2", "aa8e67692652aa0ece49069f2f9dffde6690debb563e627bab22508062ff269c"),
    ("GFDL-1.3", "24483827fdcab070dc64c6a0befe6fe64bdb823b040af911820bc5b81121dfe3"),
    ("GFDL-1.3", "3443576e476645017a4e4f30c9b3e66d8081ec21aaa139d09f59768288fd36e1"),
    ("GFDL-1.3", "3ad78df95b040dd31d3e68d1b86e1dab0aaf2108cfb79736b213c31d6366f2ad"),
    ("GFDL-1.3", "5b967c12b95f7d93d6f6004b6a40e177bcc0e67173d4cd222531f389cda0d765"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GFDL-1.3", "b667bf7cb5ccc801be3f2fa35af43a6fb630848c43a9f0223e1991217fa87c91"),
    ("GPL-1.0", "175f511abd0d3fd5f48cd40e0aaac24652ada233ca289e42f8ffdc9dd5eb8a0e"),
    ("GPL-1.0", "4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc"),
    ("GPL-1.0", "526a998a5f0ae9ed2e8c2dc03c12942fc9d724df13b0787dd3c80881d3688444"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c"),
    ("GPL-1.0", "9679cb8f8a7c25e849b925136d793d1bec010b8b9270e6ba898e2cefcb3e1f6d"),
    ("GPL-1.0", "b3df4f6a3765858f2b93d14dcdca5e0e9f3b6f76e196fc40b1256d6744177d0b"),
    ("GPL-1.0", "ca8a13e258985f008e9e869c46b2f9ce910ff6e64682660c0130a3a2597b9056"),
    ("GPL-1.0", "e0f7373f632a564663b7046e5dcb82fd3ca17509bc2b90942e1232aa84a4cca3"),
    ("GPL-1.0", "fc950c23f45be4cbd4fc1ad2acb57c168d4c44f3006950d121e6755e704ac00d"),
    ("GPL-2.0", "19329ee16e4a9fb2e74ce40708e49f5c315b4f0ac4653c556ca42027ba79f9f5"),
    ("GPL-2.0", "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f"),
    ("GPL-2.0", "4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3"),
    ("GPL-2.0", "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2"),
    ("GPL-2.0", "98e760555ff723908d803b23140ebd264fee15e7615bf9486faa0f8f6596c34f"),
    ("GPL-2.0", "b519669ce969d79c162f16dca67a0abab53b46986efb528afe3e105936cc0050"),
    ("GPL-2.0", "b6c0cac88d1c4ab1320f2eba6d8ca1b8701ea66d005555e1a7ecd05f28ddfd5b"),
    ("GPL-2.0", "b7f81dc9aaaa645304fde476859dc46db4e23b83ec1c50bd8462652ff46110c9"),
    ("GPL-2.0", "c2e92fb0d4d8a8165ca88133f385968250949f53605a7e82ac98ecb13db070b1"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "fab02e36fbede690a901c605aa4eae44e7f3cf01917bed61f085b89dfc7db7ec"),
    ("GPL-3.0", "25c090443e3540e3493172ea88c9181108effea290e12e68da7dcd1c51b4cd7a"),
    ("GPL-3.0", "39a6efa3076af232de61a13d09b777c9757af7b24bc258ead3c3e02130c0c999"),
    ("GPL-3.0", "3e83d816fbcc3e10c2eeb4df1b4cf0570ca375adba1163dcc6dfd6bd03f25804"),
    ("GPL-3.0", "466611e90eba4d297fd307e643336e06e11bd2f8a857a2d056e4f51d7802a0d4"),
    ("GPL-3.0", "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19"),
    ("GPL-3.0", "7300741b7882c4cee1198306545302285397b5dbcfa263d41588b8b85e01aefd"),
    ("GPL-3.0", "7649ebbf3b070f38d710d6c6b656cbe1d02e00991423dedb73cb040e73d42572"),
    ("GPL-3.0", "994b34ce1ab543553ca53f1d1fd5b506281e0b6935856075c411cbb6e3bace1f"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64"),
    ("GPL-3.0", "fad6d14122ae5943ea05f9e4d48194524a0b701f034fd22c7dded3e6c296c742"),
    ("LGPL-2.0", "052bf540c98a4842bad8d9f2b372e7225b1eb1d38da3916a60bc288db5e37152"),
    ("LGPL-2.0", "087179ac9dcd8b150e4cc1855b7c87043a3067ce67d8cb57deb6f9ed53959c77"),
    ("LGPL-2.0", "1bcddbd821db9aff439d7cd0cc29582bde4192194dead3bbf1218f38ca99554f"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "52c6f7dfc07e1c0b5d4cf107d72cff9e7fa07a420fcc705573c50f0fac5a726b"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "68060ac3df6b7fb29d4ae0307b72de859290da2fd8b64cc670d9510b7ce064f1"),
    ("LGPL-2.0", "81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688"),
    ("LGPL-2.0", "aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c"),
    ("LGPL-2.0", "e7ecb08f240f58455c2c9090ab912b4bb92385869e21cf6d5eddcdcfc74a1731"),
    ("LGPL-2.0", "f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e"),
    ("LGPL-2.0", "f8c3b75708c4f961de6cac15e181b74414d3fd8ba5ced4e04e2397ab85f485bc"),
    ("LGPL-2.1", "1b0f2373f80527d4e0de3c4558c0b3804f46c844770e82398a9876c782f360f9"),
    ("LGPL-2.1", "482f979099bf3ec56dd29f3fc67c705f21d132836063a2d2db55fd83c2057ca1"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4"),
    ("LGPL-2.1", "6cec265bfb1d2fddbd1dc50751fb333392bae4302e4edc8bfc51a3937ab2c9d7"),
    ("LGPL-2.1", "6d05f602d7a9f9950f9537100bd504a7fdab92cfe89f4f94b0d15721ee014b1f"),
    ("LGPL-2.1", "830fccd300ac7a6688bd8c7fabd7600cdb4a847efbc9426badac703518f9a78c"),
    ("LGPL-2.1", "8582c8c9916875b228bdd774fd968589c70e8c6acaff3326ce5e17d74d506e3d"),
    ("LGPL-2.1", "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4"),
    ("LGPL-2.1", "9c8aea52ac2706a35452528904b5cef7c0aa4140e5ec04d54ba60f53c4a5c78b"),
    ("LGPL-2.1", "e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f"),
    ("LGPL-3.0", "11a7eabf884f5575b70a6cff6628e05126a0a629a3b4fb202a995d21f65452b8"),
    ("LGPL-3.0", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("LGPL-3.0", "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a"),
    ("LGPL-3.0", "a7c65c7f11515dc58a94f889316e68122d20e78fef3c63be3ccbcf0436a416f4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0", "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765"),
    ("MPL-1.1", "1e5b0d6626b98e9f07d4d62fc1b060e7ddfc9f94ad38ae53dcc7d5c484db310c"),
    ("MPL-1.1", "3a6a0fe0030e6e755a04923126594a93aa582cc0213fe0e705392a915b23ee31"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
