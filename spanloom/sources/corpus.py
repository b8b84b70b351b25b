"""A small Chinese evaluation corpus of our own: 25 documents with three questions each.

Every document is made by rule from a place's name and number, in one of three
kinds. Answers (``gold``) stand verbatim in their document, and questions do not
repeat within one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MUSEUMS = ("青石图书馆", "河口钟表馆", "南坡陶艺馆", "旧港船模馆", "松风棋院", "白塔印刷馆", "西林植物馆", "云桥剪纸馆", "东湖茶叶馆")
TRAILS = ("鹿背岭步道", "三叠泉栈道", "望月湾骑行道", "枫谷古道", "长滩湿地", "雾溪林道", "石门峡谷", "北原草甸")
COURSES = ("木工夜校", "声乐小班", "急救培训班", "咖啡烘焙课", "书法周末班", "摄影进阶课", "游泳初级班", "园艺实践课")


def _museum(name: str, i: int) -> tuple[str, list[tuple[str, str]]]:
    year, fee, keep = f"{name}建于{1931 + 7 * i}年", f"成人票价{15 + 5 * i}元，学生凭证件减半", f"遗失物品保留{10 + i}天"
    text = (
        f"{year}，位于老城区的{'东南西北'[i % 4]}角，占地约{600 + 130 * i}平方米。最初只有{3 + i % 5}名工作人员，如今每年接待的访客超过{2 + i}万人次。很多人第一次来都会迷路，所以门口立了一块很大的导览图，上面用红点标出了所在的位置。\n\n"
        f"开放时间为每天{8 + i % 3}点到{16 + i % 3}点，周{'一二三'[i % 3]}闭馆整理。{fee}；一米二以下的儿童免费，但须有家长陪同。团体超过{10 + i}人时，请提前{2 + i % 4}天预约，否则可能要在门外等候很久。\n\n"
        f"馆里最受欢迎的是二楼的旧物展。老馆长常说：“看得慢一点，才看得见东西。”如果想带走纪念品，可以在出口左侧的小店购买，店里只收现金，每人限购{2 + i % 3}件……{keep}，过期统一处理。"
    )
    return text, [(f"{name}是哪一年建成的？", year), ("买一张成人票要多少钱，学生有优惠吗？", fee), ("丢了东西，馆里会保留多久？", keep)]


def _trail(name: str, i: int) -> tuple[str, list[tuple[str, str]]]:
    length, water, close = f"{name}全长{6 + 2 * i}公里，走完约需{2 + i % 5}小时", f"沿途只有{1 + i % 3}处补水点", f"每年{11 + i % 2}月起封山防火"
    text = (
        f"{length}。起点在停车场北侧，终点是一座废弃的水文站。前半段比较平缓，适合带孩子的家庭；后半段台阶很多，雨后石板湿滑，膝盖不好的人最好从原路返回。\n\n"
        f"请自带饮水和干粮，{water}，而且枯水期常常断流。向导提醒说：“看见云从山脊压下来，就不要再往前走了！”手机信号在第{3 + i}公里之后几乎消失，因此出发之前要把行程告诉家人，并且约好回来的时间。\n\n"
        f"春天有杜鹃，秋天有红叶，冬天则看不到什么。{close}，次年三月恢复开放；封山期间擅自进入的，罚款{200 + 50 * i}元。垃圾一律带下山，林子里不设垃圾箱、不准生火、也不准采摘野菜。"
    )
    return text, [(f"{name}有多长，走完要多久？", length), ("路上有几个地方可以补水？", water), ("什么时候开始封山？", close)]


def _course(name: str, i: int) -> tuple[str, list[tuple[str, str]]]:
    size, refund, tool = f"每班最多{8 + i}人，满{4 + i % 3}人开班", f"开课前{3 + i}天退课可以退回全部费用", f"材料费{60 + 15 * i}元另收"
    text = (
        f"{name}面向零基础的学员，{size}。课程一共{6 + i}节，每周{'三四五六'[i % 4]}晚上七点开始，每节九十分钟。第一节课会介绍安全须知，请穿不怕弄脏的衣服；迟到十五分钟以上的，当天只能旁听。\n\n"
        f"学费可以分两次缴清。{refund}，之后只退一半；开课以后不再退费，但是可以把剩下的课转给别人。{tool}，工具由教室提供，损坏要照价赔偿。已经有基础的人也可以直接报名下一期，不必从头学起。\n\n"
        f"结业的时候每人要完成一件作品，由两位老师打分，{70 + i}分以上发给证书。有学员留言说：“原来以为自己手笨，其实只是没有耐心。”需要补课的，请在一个月之内跟助教约时间，过期就不能再补了。"
    )
    return text, [("一个班最多收多少人？", size), ("课前退课能退多少钱？", refund), (f"{name}的材料费是多少？", tool)]


def corpus_rows() -> list[tuple[int, str, str, list[tuple[str, str]]]]:
    """(doc_id, title, text, [(question, gold)])."""
    made = [(name, kind(name, i)) for kind, names in ((_museum, MUSEUMS), (_trail, TRAILS), (_course, COURSES)) for i, name in enumerate(names)]
    return [(n, name, text, asked) for n, (name, (text, asked)) in enumerate(made)]


def zh_mini(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, title, text; questions: doc_id, q_idx, q, gold)."""
    rows = corpus_rows()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, title string, text string")
    asked = [(d, k, q, gold) for d, _, _, pairs in rows for k, (q, gold) in enumerate(pairs)]
    return docs, spark.createDataFrame(asked, "doc_id bigint, q_idx int, q string, gold string")
