"""A small Korean catalog with an evaluation set, written for these tests."""

CATALOG = [
    ("P1", "경량 프라이팬", "코팅 프라이팬 추천", "주방"), ("P2", "프라이팬 세트", "주방 필수", "주방"), ("P3", "도넛 모양 쿠션", "도넛 인형", "생활"), ("P4", "휴대폰 거치대", "휴대폰 차량용", "가전"),
    ("P5", "팬 미팅 굿즈", "아이돌 팬 기념품", "굿즈"), ("P6", "팬 사인회 포스터", "팬 굿즈", "굿즈"), ("P7", "물티슈 대용량", "휴대용 물티슈", "생활"), ("P8", "블루투스 스피커", "무선 블루투스", "가전"),
]
QUERIES = [("프라이팬", None, []), ("팬 굿즈", None, []), ("도넛", None, []), ("후라이팬", "spelling_variant", ["synonym_group"]), ("도너츠", "spelling_variant", ["synonym_group"])]
QRELS = [("프라이팬", "P1", 2), ("프라이팬", "P2", 2), ("팬 굿즈", "P5", 2), ("팬 굿즈", "P6", 2), ("도넛", "P3", 2), ("후라이팬", "P1", 2), ("후라이팬", "P2", 2), ("도너츠", "P3", 2)]
GOOD = {"target_query": "후라이팬", "diagnosis_family": "spelling_variant", "reasoning": "another spelling of 프라이팬", "synonym_groups": [["프라이팬", "후라이팬"]]}
BROAD = GOOD | {"synonym_groups": [["프라이팬", "후라이팬", "팬"]]}
