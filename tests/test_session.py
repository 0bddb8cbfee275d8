import os

from feedlens.session import FOLDERS, checkpoint_dir, cut_lineage, drop_cuts


def test_all_folders_of_the_package_go_and_others_stay(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    cut_lineage(spark.range(3)).count()
    for kind in FOLDERS:
        os.makedirs(f"{folder}/{kind}x", exist_ok=True)
    os.makedirs(f"{folder}/kept", exist_ok=True)
    drop_cuts(spark)
    left = os.listdir(folder)
    assert "kept" in left and not any(n.startswith(FOLDERS) for n in left)
