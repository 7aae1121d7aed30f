"""Dataset registry and named mixes (fixed values)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Robot datasets, as name, versions (oldest first), episodes, steps, camera views.
ROBOT_DATASETS: list[tuple[str, list[str], int, int, list[str]]] = [
    ("agent_aware_affordances", ["1.0.0"], 118, 151628, ["image"]),
    ("asu_table_top_converted_externally_to_rlds", ["0.1.0"], 110, 26113, ["image"]),
    ("austin_buds_dataset_converted_externally_to_rlds", ["0.1.0"], 50, 34112, ["image", "wrist_image"]),
    ("austin_sailor_dataset_converted_externally_to_rlds", ["0.1.0"], 240, 353094, ["image", "wrist_image"]),
    ("austin_sirius_dataset_converted_externally_to_rlds", ["0.1.0"], 559, 279939, ["image", "wrist_image"]),
    ("bc_z", ["0.1.0"], 39350, 5471693, ["image"]),
    ("berkeley_autolab_ur5", ["0.1.0"], 896, 87783, ["image", "hand_image"]),
    ("berkeley_cable_routing", ["0.1.0"], 1482, 38240, ["image", "top_image", "wrist225_image", "wrist45_image"]),
    ("berkeley_fanuc_manipulation", ["0.1.0"], 415, 62613, ["image", "wrist_image"]),
    ("berkeley_gnm_cory_hall", ["0.1.0"], 7331, 156012, ["image"]),
    ("berkeley_gnm_recon", ["0.1.0"], 11834, 610907, ["image"]),
    ("berkeley_gnm_sac_son", ["0.1.0"], 2955, 241059, ["image"]),
    ("berkeley_mvp_converted_externally_to_rlds", ["0.1.0"], 480, 45308, ["hand_image"]),
    ("berkeley_rpt_converted_externally_to_rlds", ["0.1.0"], 908, 392578, ["hand_image"]),
    ("bridge", ["0.1.0"], 25460, 864292, ["image"]),
    ("cmu_franka_exploration_dataset_converted_externally_to_rlds", ["0.1.0"], 199, 1990, ["image"]),
    ("cmu_play_fusion", ["0.1.0"], 576, 235922, ["image"]),
    ("cmu_playing_with_food", ["1.0.0"], 4200, 83240, ["image"]),
    ("cmu_stretch", ["0.1.0"], 135, 25016, ["image"]),
    ("columbia_cairlab_pusht_real", ["0.1.0"], 122, 24924, ["image", "wrist_image"]),
    ("dlr_edan_shared_control_converted_externally_to_rlds", ["0.1.0"], 104, 8928, ["image"]),
    ("dlr_sara_grid_clamp_converted_externally_to_rlds", ["0.1.0"], 107, 7622, ["image"]),
    ("dlr_sara_pour_converted_externally_to_rlds", ["0.1.0"], 100, 12971, ["image"]),
    ("eth_agent_affordances", ["0.1.0"], 118, 151628, ["image"]),
    ("fanuc_manipulation_v2", ["1.0.0"], 415, 62613, ["image", "wrist_image"]),
    ("fractal20220817_data", ["0.1.0"], 87212, 3786400, ["image"]),
    ("furniture_bench_dataset_converted_externally_to_rlds", ["0.1.0"], 5100, 3948057, ["image", "wrist_image"]),
    ("iamlab_cmu_pickup_insert_converted_externally_to_rlds", ["0.1.0"], 631, 146241, ["image", "wrist_image"]),
    ("imperial_wrist_dataset", ["1.0.0"], 170, 7148, ["image", "wrist_image"]),
    ("imperialcollege_sawyer_wrist_cam", ["0.1.0"], 170, 7148, ["image", "wrist_image"]),
    ("jaco_play", ["0.1.0"], 976, 70127, ["image", "image_wrist"]),
    ("kaist_nonprehensile_converted_externally_to_rlds", ["0.1.0"], 201, 32429, ["image"]),
    ("kuka", ["0.1.0"], 580392, 8583978, ["image"]),
    ("language_table", ["0.0.1", "0.1.0"], 442226, 7045476, ["rgb"]),
    ("language_table_blocktoabsolute_oracle_sim", ["0.0.1"], 200000, 15866385, ["rgb"]),
    ("language_table_blocktoblock_4block_sim", ["0.0.1"], 8298, 326768, ["rgb"]),
    ("language_table_blocktoblock_oracle_sim", ["0.0.1"], 200000, 12970620, ["rgb"]),
    ("language_table_blocktoblock_sim", ["0.0.1"], 8000, 351688, ["rgb"]),
    ("language_table_blocktoblockrelative_oracle_sim", ["0.0.1"], 200000, 13016749, ["rgb"]),
    ("language_table_blocktorelative_oracle_sim", ["0.0.1"], 200000, 8655815, ["rgb"]),
    ("language_table_separate_oracle_sim", ["0.0.1"], 200000, 3196661, ["rgb"]),
    ("language_table_sim", ["0.0.1"], 181020, 4665423, ["rgb"]),
    ("maniskill_dataset_converted_externally_to_rlds", ["0.1.0"], 30213, 4537402, ["image", "wrist_image"]),
    ("mutex_dataset", ["1.0.0"], 1500, 361883, ["image", "wrist_image"]),
    ("nyu_door_opening_surprising_effectiveness", ["0.1.0"], 435, 18196, ["image"]),
    ("nyu_franka_play_dataset_converted_externally_to_rlds", ["0.1.0"], 365, 34448, ["image", "image_additional_view"]),
    ("nyu_rot_dataset_converted_externally_to_rlds", ["0.1.0"], 14, 440, ["image"]),
    ("qut_dexterous_manpulation", ["0.1.0"], 200, 176278, ["image", "wrist_image"]),
    ("robo_net", ["0.1.0", "1.0.0"], 82775, 2483250, ["image", "image1", "image2"]),
    ("robot_vqa", ["0.1.0"], 3331523, 3331523, ["images"]),
    ("roboturk", ["0.1.0"], 1796, 168423, ["front_rgb"]),
    ("stanford_hydra_dataset_converted_externally_to_rlds", ["0.1.0"], 570, 358234, ["image", "wrist_image"]),
    ("stanford_kuka_multimodal_dataset_converted_externally_to_rlds", ["0.1.0"], 3000, 149985, ["image"]),
    ("stanford_mask_vit_converted_externally_to_rlds", ["0.1.0"], 9109, 282379, ["image"]),
    ("stanford_robocook_converted_externally_to_rlds", ["0.1.0"], 2460, 112980, ["image_1", "image_2", "image_3", "image_4"]),
    ("taco_play", ["0.1.0"], 3242, 213972, ["rgb_static", "rgb_gripper"]),
    ("tokyo_u_lsmo_converted_externally_to_rlds", ["0.1.0"], 50, 11925, ["image"]),
    ("toto", ["0.1.0"], 902, 294139, ["image"]),
    ("ucsd_kitchen_dataset_converted_externally_to_rlds", ["0.1.0"], 150, 3970, ["image"]),
    ("ucsd_pick_and_place_dataset_converted_externally_to_rlds", ["0.1.0"], 1355, 67750, ["image"]),
    ("uiuc_d3field", ["0.1.0", "1.1.2"], 196, 13384, ["image_1", "image_2", "image_3", "image_4"]),
    ("usc_cloth_sim_converted_externally_to_rlds", ["0.1.0"], 800, 80000, ["image"]),
    ("utaustin_mutex", ["0.1.0"], 1500, 361883, ["image", "wrist_image"]),
    ("utokyo_pr2_opening_fridge_converted_externally_to_rlds", ["0.1.0"], 64, 9140, ["image"]),
    ("utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds", ["0.1.0"], 192, 26346, ["image"]),
    ("utokyo_saytap_converted_externally_to_rlds", ["0.1.0"], 20, 22937, ["image", "wrist_image"]),
    ("utokyo_xarm_bimanual_converted_externally_to_rlds", ["0.1.0"], 64, 1388, ["image"]),
    ("utokyo_xarm_pick_and_place_converted_externally_to_rlds", ["0.1.0"], 92, 6789, ["image", "hand_image", "image2"]),
    ("viola", ["0.1.0"], 135, 68913, ["agentview_rgb", "eye_in_hand_rgb"]),
]

# Image datasets, as name, images.
IMAGE_DATASETS: list[tuple[str, int]] = [
    ("imagenet", 1281167),
]

# Video datasets, as name, frames.
VIDEO_DATASETS: list[tuple[str, int]] = [
    ("ego4d_1in150", 2800871),
    ("epic_kitchen_1in60", 333117),
    ("ssv2_1in32", 312772),
]

# Mixes as datasets with their weights, in order.
BRIDGE: list[tuple[str, float]] = [
    ("bridge_dataset", 1.0),
]

RT_X: list[tuple[str, float]] = [
    ("fractal20220817_data", 0.54087122203),
    ("kuka", 0.8341046294),
    ("bridge_dataset", 1.0),
    ("taco_play", 2.0),
    ("jaco_play", 2.0),
    ("berkeley_cable_routing", 3.0),
    ("roboturk", 1.0),
    ("nyu_door_opening_surprising_effectiveness", 5.0),
    ("viola", 2.0),
    ("berkeley_autolab_ur5", 1.0),
    ("toto", 1.0),
]

FRANKA: list[tuple[str, float]] = [
    ("taco_play", 1.0),
    ("berkeley_cable_routing", 1.0),
    ("viola", 1.0),
    ("toto", 1.0),
    ("stanford_hydra_dataset_converted_externally_to_rlds", 1.0),
    ("austin_buds_dataset_converted_externally_to_rlds", 3.0),
    ("nyu_franka_play_dataset_converted_externally_to_rlds", 3.0),
    ("maniskill_dataset_converted_externally_to_rlds", 0.1),
    ("furniture_bench_dataset_converted_externally_to_rlds", 0.1),
    ("cmu_franka_exploration_dataset_converted_externally_to_rlds", 5.0),
    ("austin_sailor_dataset_converted_externally_to_rlds", 1.0),
    ("austin_sirius_dataset_converted_externally_to_rlds", 1.0),
    ("berkeley_rpt_converted_externally_to_rlds", 1.0),
    ("kaist_nonprehensile_converted_externally_to_rlds", 3.0),
    ("stanford_robocook_converted_externally_to_rlds", 1.0),
    ("iamlab_cmu_pickup_insert_converted_externally_to_rlds", 1.0),
    ("utaustin_mutex", 1.0),
    ("cmu_play_fusion", 1.0),
]

MAGIC_SOUP: list[tuple[str, float]] = [
    ("fractal20220817_data", 0.54087122203),
    ("kuka", 0.8341046294),
    ("bridge", 1.0),
    ("taco_play", 2.0),
    ("jaco_play", 1.0),
    ("berkeley_cable_routing", 1.0),
    ("roboturk", 2.0),
    ("nyu_door_opening_surprising_effectiveness", 1.0),
    ("viola", 2.0),
    ("berkeley_autolab_ur5", 2.0),
    ("toto", 1.0),
    ("language_table", 0.1),
    ("stanford_hydra_dataset_converted_externally_to_rlds", 2.0),
    ("austin_buds_dataset_converted_externally_to_rlds", 1.0),
    ("nyu_franka_play_dataset_converted_externally_to_rlds", 3.0),
    ("furniture_bench_dataset_converted_externally_to_rlds", 0.1),
    ("ucsd_kitchen_dataset_converted_externally_to_rlds", 2.0),
    ("austin_sailor_dataset_converted_externally_to_rlds", 1.0),
    ("austin_sirius_dataset_converted_externally_to_rlds", 1.0),
    ("bc_z", 0.2),
    ("dlr_edan_shared_control_converted_externally_to_rlds", 1.0),
    ("iamlab_cmu_pickup_insert_converted_externally_to_rlds", 1.0),
    ("utaustin_mutex", 1.0),
    ("berkeley_fanuc_manipulation", 2.0),
    ("cmu_stretch", 1.0),
]

FULL: list[tuple[str, float]] = [
    ("fractal20220817_data", 1.0),
    ("kuka", 1.0),
    ("bridge_dataset", 1.0),
    ("taco_play", 1.0),
    ("jaco_play", 1.0),
    ("berkeley_cable_routing", 1.0),
    ("roboturk", 1.0),
    ("nyu_door_opening_surprising_effectiveness", 1.0),
    ("viola", 1.0),
    ("berkeley_autolab_ur5", 1.0),
    ("toto", 1.0),
    ("language_table", 1.0),
    ("columbia_cairlab_pusht_real", 1.0),
    ("stanford_kuka_multimodal_dataset_converted_externally_to_rlds", 1.0),
    ("nyu_rot_dataset_converted_externally_to_rlds", 1.0),
    ("stanford_hydra_dataset_converted_externally_to_rlds", 1.0),
    ("austin_buds_dataset_converted_externally_to_rlds", 1.0),
    ("nyu_franka_play_dataset_converted_externally_to_rlds", 1.0),
    ("maniskill_dataset_converted_externally_to_rlds", 1.0),
    ("furniture_bench_dataset_converted_externally_to_rlds", 1.0),
    ("cmu_franka_exploration_dataset_converted_externally_to_rlds", 1.0),
    ("ucsd_kitchen_dataset_converted_externally_to_rlds", 1.0),
    ("ucsd_pick_and_place_dataset_converted_externally_to_rlds", 1.0),
    ("austin_sailor_dataset_converted_externally_to_rlds", 1.0),
    ("austin_sirius_dataset_converted_externally_to_rlds", 1.0),
    ("bc_z", 1.0),
    ("utokyo_pr2_opening_fridge_converted_externally_to_rlds", 1.0),
    ("utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds", 1.0),
    ("utokyo_xarm_pick_and_place_converted_externally_to_rlds", 1.0),
    ("utokyo_xarm_bimanual_converted_externally_to_rlds", 1.0),
    ("robo_net", 1.0),
    ("berkeley_mvp_converted_externally_to_rlds", 1.0),
    ("berkeley_rpt_converted_externally_to_rlds", 1.0),
    ("kaist_nonprehensile_converted_externally_to_rlds", 1.0),
    ("stanford_mask_vit_converted_externally_to_rlds", 1.0),
    ("tokyo_u_lsmo_converted_externally_to_rlds", 1.0),
    ("dlr_sara_pour_converted_externally_to_rlds", 1.0),
    ("dlr_sara_grid_clamp_converted_externally_to_rlds", 1.0),
    ("dlr_edan_shared_control_converted_externally_to_rlds", 1.0),
    ("asu_table_top_converted_externally_to_rlds", 1.0),
    ("stanford_robocook_converted_externally_to_rlds", 1.0),
    ("imperialcollege_sawyer_wrist_cam", 1.0),
    ("iamlab_cmu_pickup_insert_converted_externally_to_rlds", 1.0),
    ("uiuc_d3field", 1.0),
    ("utaustin_mutex", 1.0),
    ("berkeley_fanuc_manipulation", 1.0),
    ("cmu_playing_with_food", 1.0),
    ("cmu_play_fusion", 1.0),
    ("cmu_stretch", 1.0),
    ("berkeley_gnm_recon", 1.0),
    ("berkeley_gnm_cory_hall", 1.0),
    ("berkeley_gnm_sac_son", 1.0),
]

# Models with channels, width and height of their stored features.
MODEL_SIZES: dict[str, tuple[int, int, int]] = {
    "facebook/dinov2-large": (1024, 16, 16),
    "facebook/sam-vit-huge": (256, 64, 64),
    "google/vit-huge-patch14-224-in21k": (1280, 16, 16),
    "llava-hf/llava-1.5-7b-hf": (1024, 24, 24),
    "openai/clip-vit-large-patch14": (1024, 16, 16),
    "LiheYoung/depth-anything-large-hf": (32, 64, 64),
}

# The two franka parts are concatenated, so four datasets occur twice. The full mix is usable by name, too,
# which is an addition of this library.
NAMED_MIXES: dict[str, list[tuple[str, float]]] = {
    "bridge": BRIDGE,
    "rtx": RT_X,
    "rtx_franka": RT_X + FRANKA,
    "oxe_magic_soup": MAGIC_SOUP,
    "oxe_full": FULL,
}


def registry_rows() -> list[tuple]:
    """``(dataset, kind, versions, episodes, steps, views)`` of robot, then image, then video datasets."""
    rows: list[tuple] = [(name, "robot", *entry) for name, *entry in ROBOT_DATASETS]
    for kind, listed in (("image", IMAGE_DATASETS), ("video", VIDEO_DATASETS)):
        rows += [(name, kind, [], None, steps, []) for name, steps in listed]
    return rows


def resolve_mix(mix: str | Mapping[str, float] | Sequence[str]) -> list[tuple[str, float]]:
    """Entries of a mix given by name, as a mapping, or as a list (all weights 1)."""
    if isinstance(mix, str) and mix in NAMED_MIXES:
        return NAMED_MIXES[mix]
    if isinstance(mix, Mapping):
        return [(name, float(weight)) for name, weight in mix.items()]
    if isinstance(mix, Sequence) and not isinstance(mix, str):
        return [(name, 1.0) for name in mix]
    raise ValueError(f"unsupported mix {mix!r}")
